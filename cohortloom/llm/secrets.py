"""Secret scan with DataFrame functions alone.

Base kinds come from three patterns, leftmost and without overlap. Spark has no function that returns match offsets,
so a text is both split by the pattern and searched for it: the running sum of the lengths of the pieces gives every
span, in code points, and texts without a match pay for one search only.

The method: base spans are blanked, and what is left is searched for candidates: runs of at least `WINDOW` letters,
digits and `+/_-`. A run loses the words at its ends that a separator parts from the rest, and its characters decide
its class. A window of `WINDOW` characters slides over it: the counts of the characters in the window are kept in seven
numbers of twelve counts each, with S = sum of c*log2(c) as a whole number. A character in and one out change two
counts and two terms of S, so a step costs the same whatever the length, and the entropy is log2(W) - S/W. A candidate
whose largest window reaches its class's limit is a span of kind `entropy`, unless its whole value is on the allow list:
UUIDs, one repeated character, the alphabet or the digits in order, and names of words joined by separators.

Letters of one case without digits are never reported by their entropy: long words and compounds reach that of noise.

Defined results: a null or empty text has no spans; repeated rows repeat; other columns pass through, except one named as
the output. A map over rows without shuffle or Python; time and memory grow with the length of a text, not its square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, the group or match length that counts, and the order of kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
# Texts without 20 such characters in a row need no look by the classes.
ANY_CANDIDATE = r"[A-Za-z0-9+/_-]{20}"
# Class, what a value of it is, least entropy in bits of a window; the first that fits counts. A window of 20 holds at most log2(20) = 4.32 bits.
CLASSES = [
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("lower", r"^(?=.*[0-9].*[0-9])(?=.*[a-z])[a-z0-9]+$", 3.7),
    ("upper", r"^(?=.*[0-9].*[0-9])(?=.*[A-Z])[A-Z0-9]+$", 3.7),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", 3.7),
    ("letters", r"^(?=(?:.*?[a-z][A-Z]){4})[A-Za-z]+$", 3.9),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.7),
]
# Separators at the ends of a run, and words, zeros or the ten digits there that a separator parts from the rest: no part of a candidate.
_FIRST_WORDS = "^[/_-]*+(?:(?:[A-Z]?[a-z]+|[A-Z]+|0123456789|0+)[+/_-]+)*+"
# The same from the end, for the value read backwards: anchored patterns with possessive groups take one pass and no stack.
_LAST_WORDS = "^[/_-]*+(?:(?:[a-z]+[A-Z]?|[A-Z]+|9876543210|0+)[+/_-]+)*+"
# Whole values that are no secrets.
ALLOWED = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|^(.)\1*$|^(?i:0123456789(?:abcdef(?:ghijklmnopqrstuvwxyz)?)?|abcdefghijklmnopqrstuvwxyz(?:0123456789)?)++$|^[A-Za-z]+(?:[_/-]+[A-Za-z]+)++$"
# Base spans of one run, character by character, so that blanks take the place of each.
_ACCESS_CHARACTER = r"A(?=KIA[A-Z0-9]{14})|\G(?!^)[A-Z0-9]"
_HEX_CHARACTER = r"(?<![0-9a-f])[0-9a-f](?=[0-9a-f]{15})|\G(?!^)[0-9a-f]"

# Whole-number terms of c*log2(c), so that sums stay exact however many steps they take.
_UNIT = 1 << 32
_NLOGN = [round(c * math.log2(c) * _UNIT) if c else 0 for c in range(WINDOW + 2)]
# Counts of up to 31 in five bits each, twelve to a number; characters from '+' (43) to 'z' (122).
_BITS, _PER, _NUMBERS, _FIRST = 5, 12, 7, 43
STEP = 512


def let(value: Column, body) -> Column:
    """`body` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, first: Column) -> Column:
    """first, first + v0, first + v0 + v1, ... one for each value."""
    zero = F.struct(first.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def starts(lengths: Column) -> Column:
    """What comes before each of the lengths; in two levels, as an array that grows by one is copied each time."""
    zero = F.lit(0).cast("long")

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(STEP)), lambda i: F.slice(v, i, STEP))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, _scan(F.transform(b, lambda x: F.aggregate(x, zero, lambda t, y: t + y)), zero), _scan)))

    return let(lengths, of)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, value) of every match, leftmost and without overlap."""
    pieces = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda v, g: F.struct(v.alias("v"), F.length(g).cast("long").alias("g"), F.length(v).cast("long").alias("n")),
    )

    def placed(found: Column) -> Column:
        at = starts(F.transform(found, lambda x: x["g"] + x["n"]))
        return F.zip_with(found, at, lambda x, s: F.struct(F.lit(kind).alias("kind"), (s + x["g"]).alias("start"), (s + x["g"] + x["n"]).alias("end"), x["v"].alias("value")))

    # The last piece has no match behind it.
    return F.when(F.rlike(text, F.lit(pattern)), let(F.filter(pieces, lambda x: x["v"].isNotNull()), placed)).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,value:string>>)")


def _assigned(value: Column) -> Column:
    return F.length(F.regexp_extract(value, ASSIGN, 2)) >= ASSIGN_LEAST


def outside_base(text: Column) -> Column:
    """The text with a blank for every character of a base span."""
    blank = lambda v: F.when(_assigned(v), F.repeat(F.lit(" "), F.length(v))).otherwise(v)
    joined = F.array_join(F.zip_with(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), F.split(text, ASSIGN, -1), lambda v, g: F.concat(g, F.coalesce(blank(v), F.lit("")))), "")
    without = F.when(F.rlike(text, F.lit(ASSIGN)), joined).otherwise(text)
    return F.regexp_replace(F.regexp_replace(without, _ACCESS_CHARACTER, " "), _HEX_CHARACTER, " ")


def largest_entropy(value: Column) -> Column:
    """Largest Shannon entropy (bits) of a sliding window of WINDOW characters, by incremental counts; 0 for shorter values."""
    code = lambda c: F.ascii(c) - _FIRST
    term = lambda c: F.element_at(F.lit(_NLOGN).cast("array<bigint>"), (c + 1).cast("int"))
    number, shift = lambda c: F.floor(c / _PER).cast("int"), lambda c: F.pmod(c, F.lit(_PER)) * _BITS
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
    zero = F.struct(F.lit([0] * _NUMBERS).cast("array<bigint>").alias("counts"), F.lit(0).cast("long").alias("s"), F.lit(1 << 62).cast("long").alias("least"), F.lit(0).alias("i"))

    def held(counts: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.element_at(counts, number(c) + 1), shift(c)).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        came, left = x["came"], x["left"]
        full = left.isNotNull()
        # One out, ...
        c_out = F.when(full, held(acc["counts"], left))
        s = acc["s"] + F.when(full, term(c_out - 1) - term(c_out)).otherwise(F.lit(0).cast("long"))
        # ... one in.
        c_in = held(acc["counts"], came) - F.when(full & (left == came), 1).otherwise(0)
        s = s + term(c_in + 1) - term(c_in)
        counts = F.transform(acc["counts"], lambda n, k: n + F.when(k == number(came), one(came)).otherwise(F.lit(0).cast("long")) - F.when(full & (k == number(left)), one(left)).otherwise(F.lit(0).cast("long")))
        least = F.when(acc["i"] >= WINDOW - 1, F.least(acc["least"], s)).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), s.alias("s"), least.alias("least"), (acc["i"] + 1).alias("i"))

    def of(codes: Column) -> Column:
        behind = F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), codes)
        both = F.zip_with(codes, F.slice(behind, F.lit(1), F.size(codes)), lambda a, b: F.struct(a.alias("came"), b.alias("left")))
        return F.aggregate(both, zero, step, lambda acc: F.lit(math.log2(WINDOW)) - acc["least"] / F.lit(float(_UNIT * WINDOW)))

    plain = F.rtrim(F.translate(value, "=", ""))
    return F.when(F.length(value) >= WINDOW, let(F.transform(F.split(plain, ""), code), of)).otherwise(F.lit(0.0))


def _trimmed(s: Column) -> Column:
    """A candidate without the words at its ends."""
    cut = F.length(F.regexp_extract(s["value"], _FIRST_WORDS, 0)).cast("long")
    rest = F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(s["value"], _FIRST_WORDS, "")), _LAST_WORDS, ""))
    return F.struct(s["kind"].alias("kind"), (s["start"] + cut).alias("start"), (s["start"] + cut + F.length(rest)).alias("end"), rest.alias("value"))


def _is_secret(s: Column) -> Column:
    limit = F.lit(None).cast("double")
    for _, fits, least in reversed(CLASSES):
        limit = F.when(F.rlike(s["value"], F.lit(fits)), least).otherwise(limit)
    long_enough = F.length(s["value"]) >= WINDOW
    return F.when(long_enough & ~F.rlike(s["value"], F.lit(ALLOWED)), F.coalesce(largest_entropy(s["value"]) >= limit, F.lit(False))).otherwise(F.lit(False))


def secret_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds an array of (kind, start, end, value) of every whole text: assign, access, hex, then entropy; by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(F.filter(matches(t, ASSIGN, "assign"), lambda s: _assigned(s["value"])), matches(t, ACCESS, "access"), matches(t, HEX, "hex"))
    out = docs.select(*[c for c in docs.columns if c != spans], base.alias("__base"))
    rest = F.when(F.size("__base") > 0, outside_base(t)).otherwise(t)
    candidates = let(rest, lambda x: F.transform(matches(x, CANDIDATE, "entropy"), _trimmed))
    added = F.when(F.rlike(t, F.lit(ANY_CANDIDATE)), F.filter(candidates, _is_secret)).otherwise(_no_spans())
    order = lambda kind: F.array_position(F.array(*map(F.lit, ("assign", "access", "hex", "entropy"))), kind)
    keyed = F.transform(F.concat("__base", "__added"), lambda s: F.struct(s["start"].alias("start"), order(s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    back = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    out = out.withColumn("__added", added)
    return out.withColumn(spans, F.when(F.size("__base") + F.size("__added") > 0, back).otherwise(_no_spans())).drop("__base", "__added")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans, per document."""
    found = secret_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[count(k) for k in ("assign", "access", "hex")], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
