"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage is written as Parquet to the shared folder and read again as the next one's documents, so a stage starts
from files however often its tasks are lost, and works on all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import bpe, decontaminate, pii, quality, simhash
from cohortloom.llm.common import saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs, into="__quality").where("__quality.kept").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id: SimHash, verified, and an exact search for what it misses."""
    return simhash.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Rows go by what their text holds, whatever their ids, null ids too."""
    named = docs.withColumn("__digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = decontaminate.contaminated(named, table(spark, sf_dir, "benchmark"), doc="__digest").select("__digest").distinct()
    return named.join(saved(found, "contaminated"), "__digest", "left_anti").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    out = pii.personal_spans(docs, spans="__spans", redacted="text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens: doc_id, source, lang, text, ids, and count and digests of the ids and of what they decode to."""
    import public_tokenizers

    out = bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id", "source", "lang", "text", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("tokens", token_stage),
]

# SQL has no zstandard, no XXH64 and no byte-pair encoding: the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
