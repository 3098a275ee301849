"""Strict parsing and validation of text fields, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing measurement and of categorical results.
MISSING = ("", "na", "n/a", "null", ".")
STATUS = {
    "positive": "positive", "pos": "positive", "+": "positive",
    "negative": "negative", "neg": "negative", "-": "negative",
    "equivocal": "equivocal", "not tested": "not_tested", "not_tested": "not_tested", "unknown": "unknown",
}

NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strict_double(text: Column) -> Column:
    """A plain decimal number; no suffixes, hexadecimal or words."""
    return F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_missing(text: Column) -> Column:
    return text.isNull() | ascii_lower(stripped(text)).isin(*MISSING)


def category(text: Column) -> Column:
    """Canonical status of a categorical result, null if it has none."""
    key = ascii_lower(stripped(text))
    found = F.lit(None).cast("string")
    for alias, name in STATUS.items():
        found = F.when(key == alias, name).otherwise(found)
    return found


def age(text: Column) -> Column:
    """(years, lower_bound_exclusive): '>89' is a bound, digits are years, anything else neither."""
    bound = F.regexp_extract(text, r"\A>(\d{1,3})\z", 1).try_cast("int")
    years = F.regexp_extract(text, r"\A(\d{1,3})\z", 1).try_cast("int")
    return F.struct(F.when(years <= 130, years).alias("years"), bound.alias("lower_bound_exclusive"))


def strict_date(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"\A\d{4}-\d{2}-\d{2}\z")), F.try_to_date(text, "yyyy-MM-dd"))


def is_id(text: Column, most: int = 64, dots: bool = False) -> Column:
    return F.rlike(text, F.lit(rf"\A[A-Za-z0-9_{'.' if dots else ''}-]{{1,{most}}}\z"))


def is_sha256(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\A[0-9a-f]{64}\z"))


def is_label(text: Column, most: int = 128) -> Column:
    """Not blank, no control characters, at most `most` bytes."""
    return (stripped(text) != "") & (F.octet_length(text) <= most) & ~F.rlike(text, F.lit(r"\p{Cntrl}"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def fingerprint(*columns: str) -> Column:
    """SHA-256 of a row as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def bucket_10000(text: Column) -> Column:
    """The first 8 bytes of SHA-256 as a number, modulo 10,000."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(10000)).cast("int")
