"""Recall of the containment search by size partition, at the threshold itself, with extra columns and at other thresholds."""

import random

import pytest

from cohortloom.llm import decontaminate as D


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_every_partition_finds_items_at_the_threshold(spark, threshold):
    r = random.Random(9)
    word = lambda: f"v{r.randrange(10**7)}"
    items, docs, want = [], [], set()
    for part in range(11):
        for k in range(6):
            n = r.randrange(2**part, 2 ** (part + 1))
            words = [word() for _ in range(n + D.WORDS - 1)]
            item = len(items)
            items.append((item, " ".join(words)))
            # A passage from the front that holds `share` of the shingles, inside a longer text of other words.
            share = -(-n * threshold // 1) if k % 2 == 0 else max(1, int(n * threshold) - 1)
            kept = words[: int(share) + D.WORDS - 1]
            docs.append((item, " ".join([*(word() for _ in range(80)), *kept, *(word() for _ in range(60))])))
            if share >= threshold * n:
                want.add((item, item))
    df = spark.createDataFrame([(*d, "a", 1, 2.0) for d in docs], "doc_id long, text string, item_id string, n_found int, containment double").repartition(4)
    found = D.contaminated(df, spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string"), threshold=threshold)
    assert found.columns == ["doc_id", "item_id", "n_shingles", "n_found", "containment"]
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want
    exact = D.contaminated(df, spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string"), threshold=threshold, whole=True)
    assert {(x["doc_id"], x["item_id"]) for x in exact.collect()} == want
    parts = {x["__part"] for x in D.signatures(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").select("__part").distinct().collect()}
    assert parts == set(range(11))


def test_signatures_grow_with_the_partition():
    lengths, hits = [D.signature_length(p) for p in range(15)], [D.hits_asked(p) for p in range(15)]
    assert lengths == sorted(lengths) and hits == sorted(hits) and all(1 <= h <= k for h, k in zip(hits, lengths))
    assert lengths[10] < 2**10 and hits[10] > 0.5 * lengths[10]


def test_whole_signatures_miss_nothing(spark, monkeypatch):
    """With signatures that would miss most documents, the exact way still finds all."""
    from pyspark.sql import functions as F

    r = random.Random(4)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(400))
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + text + " c"), (2, text[:-200])], "doc_id long, text string")
    monkeypatch.setattr(D, "hits_asked", lambda part, threshold=D.THRESHOLD: 10**6)
    assert D.contaminated(docs, items).count() == 0 and D.contaminated(docs, items, whole=True).count() == 2
    signed = D.signatures(items, "item_id", "text", whole=True).agg(F.count("*").alias("n"), F.max("__need").alias("need")).first()
    assert (signed["n"], signed["need"]) == (396, 317)
