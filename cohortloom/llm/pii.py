"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, schemes and identifier cues.
At each anchor a deterministic local parser expands to the left and right and validates what it got: e-mail
boundaries, dotted addresses (parts of at most 255), card numbers (Luhn), phone numbers, IBANs (mod 97), social
security and account numbers after a cue, and URLs that carry user data. No parser looks further than the run of
characters its kind allows, and no run is read again, so time grows with the length of a text and not with its square.

Kinds in order: email, ip, card, phone (the base), then url, iban, ssn, account (added by the method).
Offsets are code points, end exclusive. Defined results: a null or empty text has no spans; repeated rows repeat;
other columns pass through, except one named as the output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["url", "iban", "ssn", "account"]
KINDS = BASE_KINDS + ADDED_KINDS

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT_RUN = re.compile(r"[0-9. -]+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"://[^\s<>\"'`]+")
_IBAN = re.compile(r"[ :#.-]{0,6}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_SSN = re.compile(r"[ :#.-]{0,6}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(r"(?: ?(?:number|no|nr|num))?[ :#.]{1,4}([0-9]{6,17})(?![0-9])", re.I)
_NOT_DIGIT = re.compile("[^0-9]")


def _cues() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    anchors = {"@": "@", "+": "+", "://": "u"} | {d: "d" for d in "0123456789"}
    for word, kind in (("iban", "i"), ("ssn", "s"), ("account", "a"), ("acct", "a")):
        anchors |= {w: kind for w in (word, word.upper(), word.capitalize())}
    for word, kind in anchors.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> int:
    """Length of the longest valid IBAN at the start of the candidate, 0 if none."""
    for end in range(len(text), 14, -1):
        if text[end - 1] == " ":
            continue
        plain = text[:end].replace(" ", "")
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
    return 0


class Anchors:
    def __init__(self):
        self.cues = _cues()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind."""
        if not text:
            return []
        found: list[tuple[str, int, int]] = []
        email_end = digits_end = url_end = 0
        for last, (kind, n) in self.cues.iter(text):
            at = last - n + 1
            if kind == "d":
                if at < digits_end:
                    continue
                digits_end = self._digits(text, at, found)
            elif kind == "@":
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    found.append(("email", start, m.end()))
                    email_end = m.end()
            elif kind == "+":
                if (m := _PHONE.match(text, at)) and 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", at, m.end()))
            elif kind == "u":
                start = at
                while start > url_end and at - start < 12 and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at and (m := _URL_REST.match(text, at)):
                    url_end = m.end()
                    if "@" in m[0]:
                        found.append(("url", start, m.end()))
            elif kind == "i":
                if (m := _IBAN.match(text, last + 1)) and (size := _iban_ok(m[1])):
                    found.append(("iban", m.start(1), m.start(1) + size))
            elif kind == "s":
                if m := _SSN.match(text, last + 1):
                    found.append(("ssn", m.start(1), m.end(1)))
            elif m := _ACCOUNT.match(text, last + 1):
                found.append(("account", m.start(1), m.end(1)))
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))

    @staticmethod
    def _digits(text: str, at: int, found: list[tuple[str, int, int]]) -> int:
        """Addresses and cards of the run of digits, dots, blanks and hyphens that starts here; the run's end."""
        end = _DIGIT_RUN.match(text, at).end()
        if end - at < 7:
            return end
        # Numbers joined by single dots, taken four at a time from the left, as a pattern of four would find them.
        for m in _DOTTED.finditer(text, at, end):
            parts = m[0].split(".") if "." in m[0] else []
            start = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append(("ip", start, start + size))
                start += size + 1
        for m in _CARD.finditer(text, at, end):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        return end


def personal_spans(docs: DataFrame, text: str = "text", spans: str = "spans", redacted: str | None = None) -> DataFrame:
    """Adds every whole text's spans (array of kind, start, end); with `redacted`, also the text with each span as <KIND>."""
    kept = docs.select([c for c in docs.columns if c not in (spans, redacted)] + ([] if redacted != text else [text]))
    added = [T.StructField(spans, SPAN), *([T.StructField(redacted or "", T.StringType())] if redacted else [])]
    rest = [f for f in kept.schema.fields if f.name != redacted]
    schema = T.StructType([*rest, *added])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [anchors.spans(t) for t in texts]
            columns = [batch.column(f.name) for f in rest]
            columns.append(pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], span_type))
            if redacted:
                columns.append(pa.array([redact(t, x) if x else t for t, x in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return kept.mapInArrow(apply, schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or what is left of it after those before, becomes its kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def span_text(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans, per document."""
    found = personal_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
