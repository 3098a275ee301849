"""Noise of every alphabet is rejected at every length and as chunks; the tables' clean texts are kept."""

import random
import string
import time
import uuid

import pyarrow.parquet as pq
import pytest
from test_contracts import brute_quality

from cohortloom.llm import quality

ALPHABETS = {
    "base32": string.ascii_uppercase + "234567", "letters": string.ascii_lowercase, "both cases": string.ascii_letters, "digits": string.digits, "hexadecimal": "0123456789abcdef", "base64": string.ascii_letters + string.digits + "+/",
    "two": "01", "bases": "ACGT", "accents": string.ascii_lowercase + "äöüßéèñ",
}
SIZES = [600, 1000, 1500, 2048, 4000, 5000, 8192, 20_000, 200_000]


def noise(kind, size, r):
    if kind == "uuid":
        return " ".join(str(uuid.UUID(int=r.getrandbits(128))) for _ in range(size // 37 + 1))[:size]
    words, n = [], 0
    while n < size:
        k = r.randrange(6, 13)
        words.append("".join(r.choices(ALPHABETS[kind], k=k)))
        n += k + 1
    return " ".join(words)[:size]


@pytest.mark.parametrize("kind", [*ALPHABETS, "uuid"])
def test_noise(kind):
    rules = quality.Rules()
    for size in SIZES:
        for seed in range(6 if size < 20_000 else 1):
            got = rules.measure(noise(kind, size, random.Random(seed)))
            assert got[6] is False, (kind, size, got)


@pytest.fixture(scope="module")
def clean():
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    q = {x["doc_id"]: x for x in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    return [x["text"] for x in t if x["text"] and q.get(x["doc_id"], {}).get("quality") == 1 and not brute_quality(x["text"])[5]]


def test_clean_texts_are_kept(clean):
    rules = quality.Rules()
    kept = [rules.measure(t)[6] for t in clean]
    assert len(kept) > 100 and sum(kept) >= 0.99 * len(kept), (sum(kept), len(kept))


@pytest.mark.parametrize("kind", [*ALPHABETS, "uuid"])
def test_noise_in_chunks(clean, kind):
    prose = " ".join(clean)[:12_288]
    got = quality.Rules().measure(prose + noise(kind, 24_000, random.Random(3)))
    assert got[6] is False, got


def test_a_megabyte(clean):
    rules, r = quality.Rules(), random.Random(5)
    start = time.perf_counter()
    prose = " ".join(clean)
    prose = (prose * (1 + (1 << 20) // len(prose)))[: 1 << 20]
    for text in ("x" * (1 << 20), "a b " * (1 << 18), noise("letters", 1 << 20, r), prose, "😀" * (1 << 18), "".join(map(chr, range(0x4E00, 0x9E00))) * 12):
        assert len(rules.measure(text)) == len(quality.ADDED)
    assert time.perf_counter() - start < 30
