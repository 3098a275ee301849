"""Every operator on documents: empty tables, and extra columns that are named as its own results and helpers."""

import public_tokenizers
import pytest
from cases import frame
from pyspark.sql import functions as F

from cohortloom.llm import bpe, licenses, merkle, periods, pieces, pii, quality, repeats, secrets, simhash

OPERATORS = {
    "op1": lambda d: bpe.token_digests(d, public_tokenizers.path("word_bpe_49k.json")), "op2": repeats.repeat_digests, "op3": simhash.simhash_components, "op5": licenses.license_scan, "op6": pii.pii_digests, "op9": secrets.secret_digests,
    "op10": quality.quality_report, "op13": merkle.manifest_digests, "op12": periods.period_digests, "op11": lambda d: pieces.piece_digests(d, public_tokenizers.path("piece_bpe_32k.model")), "stage3": simhash.without_near_duplicates,
}
CLASHING = ["ids", "decoded", "n_bytes", "kept", "blob", "chunk", "fp", "fingerprint", "component_id", "key", "node", "root", "digest", "labels", "score", "spans", "value", "kind", "start", "quality", "kept_sha256", "reason"]


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_and_empty_tables(spark, name):
    make, df = OPERATORS[name], frame(spark)
    plain = make(df)
    own = [c for c in plain.columns if name != "stage3" or c in ("doc_id", "text")]
    other = make(df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)]))
    rows = lambda d: sorted(map(str, d.select(own).collect()))
    assert rows(other) == rows(plain)
    assert make(df.limit(0)).count() == 0
