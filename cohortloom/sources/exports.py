"""Tables and short texts for readers: measurements, attributions and a study report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 200


def measurements(records: DataFrame, unit: str, source_sha256: str) -> DataFrame:
    """Measurements with where they come from, twelve columns."""
    return records.select(
        "sample_id", "record", "source_column", "original", F.col("mapping").alias("mapping_status"), "gene", F.col("raw").alias("raw_value"), "status", "value",
        F.lit(unit).alias("unit"), F.array_join(F.coalesce("candidates", F.array().cast("array<string>")), "|").alias("candidates"), F.lit(source_sha256).alias("source_sha256"),
    )


def attributions(contributions: DataFrame, class_id: str, base: float, full: float) -> DataFrame:
    """Contributions by size, also in percentage points."""
    return contributions.select(F.lit(class_id).alias("class_id"), "feature", "contribution", F.round(F.col("contribution") * 100, 4).alias("percentage_points"), F.lit(base).alias("base"), F.lit(full).alias("full")).orderBy(F.desc(F.abs("contribution")), "feature")


def escaped(text) -> str:
    """A cell of a Markdown table: no bars, no markup, no control characters."""
    clean = "".join(c if c.isprintable() else " " for c in str(text))
    for c in "\\|*_`<>[]":
        clean = clean.replace(c, "\\" + c)
    return clean


def escaped_xml(text) -> str:
    """Text of an XML element or attribute: the five marks as entities, characters that XML has no place for left out."""
    allowed = lambda c: c in "\t\n\r" or " " <= c <= "\ud7ff" or "\ue000" <= c <= "\ufffd" or c > "\uffff"
    out = "".join(c for c in str(text) if allowed(c))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = out.replace(mark, entity)
    return out


def report_json(report: dict, limit: int = 100_000) -> str:
    """A report as one JSON document: tables as lists of rows. A table beyond the limit is refused, never cut."""

    def plain(value):
        if isinstance(value, DataFrame):
            rows = value.limit(limit + 1).collect()
            if len(rows) > limit:
                raise ValueError(f"a table of more than {limit} rows has no place in a document")
            return [r.asDict(recursive=True) for r in rows]
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        return value

    return json.dumps(plain(report), default=str, sort_keys=True)


def markdown_table(df: DataFrame, limit: int = SHOWN) -> str:
    """A small result as Markdown; rows beyond the limit are named, not shown."""
    rows = df.limit(limit + 1).collect()
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else escaped(v)
    lines = ["| " + " | ".join(map(escaped, df.columns)) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join(shown(v) for v in r) + " |" for r in rows[:limit]]
    return "\n".join(lines + ["", f"More than {limit} rows."] * (len(rows) > limit))


def study_markdown(report: dict, title: str = "Study") -> str:
    """The report of plans.study: tables as tables, reasons as they are."""
    out = [f"# {escaped(title)}"]
    for name, value in report.items():
        out.append(f"\n## {escaped(name.replace('_', ' '))}\n")
        if isinstance(value, DataFrame):
            out.append(markdown_table(value))
        elif isinstance(value, dict):
            out += [f"### {escaped(k)}\n\n{markdown_table(v) if isinstance(v, DataFrame) else escaped(v)}\n" for k, v in value.items() if k != "rows"]
        else:
            out.append(escaped(value))
    return "\n".join(out)
