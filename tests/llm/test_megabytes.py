"""Texts of a megabyte for operators without a test of their own for them: results that are known, within a time limit."""

import random
import string
import time

import public_tokenizers
import pytest
import tokenizers
from cases import DOCS
from pyspark.sql import functions as F

from cohortloom.llm import bpe, decontaminate, repeats, simhash

MB = 1 << 20


def letters(n, seed):
    return "".join(random.Random(seed).choices(string.ascii_lowercase, k=n))


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices(string.ascii_lowercase, k=r.randrange(2, 9))) for _ in range(n))


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("text", ["x" * MB, letters(MB, 1), words(MB // 6, 2), "ab\n" * (MB // 3), "é😀" * (MB // 6)])
def test_bpe(spark, text):
    path = public_tokenizers.path("word_bpe_49k.json")
    start = time.perf_counter()
    row = bpe.round_trip(frame(spark, text), path).first()
    assert time.perf_counter() - start < 90
    library = tokenizers.Tokenizer.from_file(path)
    if len(text) != MB:
        assert row["ids"] == library.encode(text, add_special_tokens=False).ids


def test_repeats(spark):
    shared, start = letters(MB // 2, 3), time.perf_counter()
    first, second = "0" + shared + "1" + letters(MB // 2, 4), letters(MB // 2, 5) + "2" + shared + "3"
    got = {r["doc_id"]: r for r in repeats.repeat_digests(frame(spark, first, second, "z" * MB, "z" * MB)).collect()}
    assert time.perf_counter() - start < 120
    assert [(got[k]["n_removed"], got[k]["n_spans"]) for k in range(4)] == [(0, 0), (MB // 2, 1), (0, 0), (MB, 1)]


def test_simhash(spark):
    text, start = words(MB // 6, 6), time.perf_counter()
    other = text.replace(" ", "  ", 1)[:-30] + " end"
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(frame(spark, text, other, words(MB // 6, 7), "x" * MB)).collect()}
    assert time.perf_counter() - start < 90
    assert got[0] == got[1] == 0 and got[2] != 0 and got[3] != 0


def test_decontamination(spark):
    item, start = words(60, 8), time.perf_counter()
    long = words(MB // 12, 9) + " " + item.upper() + ". " + words(MB // 12, 10)
    items = spark.createDataFrame([(1, item), (2, words(60, 11))], "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, long, words(MB // 6, 12), "x" * MB), items).select("doc_id", "item_id", F.round("containment", 6)).collect()
    assert time.perf_counter() - start < 90 and [tuple(r) for r in found] == [(0, 1, 1.0)]
