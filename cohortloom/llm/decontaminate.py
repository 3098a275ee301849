"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions alone.

Items are short and documents long, so signatures of both sides of one length would say nothing: what MinHash does give
is containment. Of the shingles of an item that come first in a random order, a document that holds a share c of the item
holds about that share. Items are partitioned by their number of shingles, in powers of two, and every partition is
searched with its own signature length and its own number of hits that make a candidate:

* up to 2**5 shingles the signature is the whole item and a candidate holds the threshold's share of it, no less;
* above, the signature grows with the square root of the size (`signature_length`), and the hits asked for are the most
  that a document at the threshold falls short of with a probability of at most `MISS` (Chernoff's bound).

Documents stream their shingle hashes past the signatures, which is their side of the search: a document has no signature
of its own, as any bounded one would lose a short item in a long text. Each candidate is verified by exact containment
of the shingle texts. The signature table is broadcast only if its counted rows are at most `BROADCAST_ROWS`, else both
sides are shuffled by shingle hash.

Shingles are of five words, lower-cased, words being runs of letters and digits. Defined results: items of fewer words,
or with a null text or id, have no shingle and match nothing; null or empty documents, or with a null id, contain
nothing; empty tables give no rows. Repeated rows of an item count as one, of a document too; rows of one id with other
texts are searched one by one and the best counts. The result has each (doc_id, item_id) once, and no other columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.llm.common import saved

WORDS = 5
THRESHOLD = 0.8
WHOLE = 5
MISS = 1e-10
LARGEST = 20
BROADCAST_ROWS = 1_000_000


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _positions(words: str) -> Column:
    return F.sequence(F.lit(0), F.size(words) - WORDS)


def _hashes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash) of every shingle, repeats included, in one streaming pass without a shuffle."""
    at = rows.select(F.col(key), word_array(F.col(text)).alias("__w")).where(F.size("__w") >= WORDS)
    at = at.select(key, "__w", F.explode(_positions("__w")).alias("__i"))
    return at.select(key, F.xxhash64(*[F.get("__w", F.col("__i") + k) for k in range(WORDS)]).alias("__h"))


def _shingles(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, array of distinct shingle texts)."""
    words = rows.select(F.col(key), word_array(F.col(text)).alias("__w")).where(F.size("__w") >= WORDS)
    made = F.transform(_positions("__w"), lambda i: F.concat_ws(" ", *[F.get("__w", i + k) for k in range(WORDS)]))
    return words.select(key, F.array_distinct(made).alias("__s"))


def _bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast, given only after the rows have been counted."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def signature_length(part: int) -> int:
    """Hashes of an item of 2**part to 2**(part + 1) - 1 shingles."""
    return 2 ** (part + 1) - 1 if part < WHOLE else math.ceil(2**WHOLE * 2 ** ((part - WHOLE) / 2))


def hits_asked(part: int, threshold: float = THRESHOLD) -> int:
    """Most hits that a document at the threshold has with a probability of at least 1 - MISS."""
    k = signature_length(part)

    def below(hits: int) -> float:
        """Bound of the probability of fewer hits."""
        x = (hits - 1) / k
        if x >= threshold:
            return 1.0
        return math.exp(-k * ((x * math.log(x / threshold) if x else 0.0) + (1 - x) * math.log((1 - x) / (1 - threshold)))) if threshold < 1 else 0.0

    return max([1, *(h for h in range(1, k + 1) if below(h) <= MISS)])


def signatures(items: DataFrame, item: str, text: str, threshold: float = THRESHOLD, whole: bool = False) -> DataFrame:
    """(item, __h, __part, __need): the signature of every item, its partition and how many of its hashes make a candidate.

    With `whole` every item's signature is all of its shingles.
    """
    each = _hashes(items.where(F.col(item).isNotNull()), item, text).distinct()
    first = W.partitionBy(item).orderBy(F.xxhash64("__h", F.lit(7)), "__h")
    n = F.count(F.lit(1)).over(W.partitionBy(item))
    ranked = each.select(item, "__h", F.row_number().over(first).alias("__r"), n.alias("__n"))
    part = F.least(F.floor(F.log2(F.col("__n"))), F.lit(LARGEST)).cast("int")
    of = lambda values: F.element_at(F.lit(values), part + 1)
    length, hits = of([signature_length(p) for p in range(LARGEST + 1)]), of([hits_asked(p, threshold) for p in range(LARGEST + 1)])
    # A small item is searched whole, so that fewer hits than the threshold's share rule it out for certain.
    share = F.greatest(F.lit(1), F.ceil(F.col("__n") * threshold - 1e-9))
    if whole:
        return ranked.select(item, "__h", part.alias("__part"), share.cast("int").alias("__need"))
    need = F.when(part < WHOLE, share).otherwise(hits)
    return ranked.where(F.col("__r") <= length).select(item, "__h", part.alias("__part"), need.cast("int").alias("__need"))


def contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", threshold: float = THRESHOLD, whole: bool = False) -> DataFrame:
    """(doc, item, n_shingles, n_found, containment) of every document that contains at least `threshold` of an item.

    Signatures of items of 2**WHOLE shingles or more miss such a document with a probability of at most MISS; `whole` misses
    none, at the price of a signature as long as the item.
    """
    docs, items = docs.select(doc, text).where(F.col(doc).isNotNull()), items.select(item, text)
    signed = saved(signatures(items, item, text, threshold, whole), "signatures")
    met = _hashes(docs, doc, text).join(_bounded(signed), "__h").select(doc, item, "__part", "__h", "__need").distinct()
    hits = met.groupBy(doc, "__part", item).agg(F.count(F.lit(1)).alias("__c"), F.max("__need").alias("__need"))
    candidates = saved(hits.where("__c >= __need").select(doc, item), "candidates")
    ids = candidates.select(doc).distinct()
    exact = _shingles(items.where(F.col(item).isNotNull()), item, text).groupBy(item).agg(F.array_distinct(F.flatten(F.collect_list("__s"))).alias("__want"))
    held = _shingles(docs.join(_bounded(ids), doc, "left_semi"), doc, text)
    both = held.join(candidates, doc).join(exact, item)
    found = both.select(doc, item, F.size("__want").cast("long").alias("n_shingles"), F.size(F.array_intersect("__want", "__s")).cast("long").alias("n_found"))
    best = found.groupBy(doc, item, "n_shingles").agg(F.max("n_found").alias("n_found"))
    return best.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= threshold)


SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{WORDS - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM dw WHERE len(w) >= {WORDS})),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
si AS (SELECT DISTINCT item_id, array_to_string(w[i:i+{WORDS - 1}], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM iw WHERE len(w) >= {WORDS})),
n AS (SELECT item_id, count(*) AS n FROM si GROUP BY 1)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found, count(*) / n AS containment
FROM ds JOIN si USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= {THRESHOLD} * n
"""
