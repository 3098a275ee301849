"""Periodic runs of words: stretches that repeat with a smallest period at least `min_exp` times, found at every lag.

A text is an array of word numbers. For each lag q up to n / min_exp the array is compared with itself shifted by q; a
stretch of equal places, `stretch` of them or more, is a run with period q. Lags are taken in blocks q0 <= q < 2 q0,
a block at once: any stretch of a block holds four places of a grid of a quarter of the least stretch, so the shifts are
first compared on the grid, all lags of the block in one array, and a lag is compared place by place only around four
equal grid places in a row. That leaves no stretch out and makes a block cost some 4/3 n comparisons, n log n in all.

A stretch whose period isn't its smallest is known by a divisor: with two repetitions or more, a smaller period divides
the lag, and the stretch is then that period's run cut short by the lag. Runs of lower blocks are taken off beforehand,
so that a text of one word, which has runs at every lag, isn't compared over and over; what is left is tested against
the lag divided by each of its primes.

Long texts are dealt out: word numbers and a range of lag blocks are a row, rows are spread over the tasks, and the runs
of a text come together in its own row. Each range finds runs of the lags below `SMALL` for itself. Long texts are
written once with a number each, so copies of one text are no hot key.

Defined results: a null or empty text has no runs and collapses to the empty text; repeated rows repeat; other columns
pass through, except those named as the outputs; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.common import saved

MIN_EXP, MIN_LENGTH = 4, 6
LONG_BYTES = 1 << 16
RANGE_WORDS = 1 << 14
SMALL = 16
CELLS = 1 << 20
ROWS_AT_ONCE = 1024

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
RUNS = T.ArrayType(RUN, False)
_ARROW_RUNS = pa.list_(pa.field("element", pa.struct([pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("period", pa.int64())]), nullable=False))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    slots: dict[bytes, int] = {}
    return np.fromiter((slots.setdefault(w, len(slots)) for w in words), np.int32, len(words))


def _primes(q: int) -> list[int]:
    found, d = [], 2
    while d * d <= q:
        if q % d == 0:
            found.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return found + ([q] if q > 1 else [])


def _stretches(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of stretches of at least that many true places."""
    edges = np.flatnonzero(np.diff(equal, prepend=False, append=False))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= least:
            yield a, b


class Scan:
    """All runs of an array of word numbers, by ranges of lags."""

    def __init__(self, ids: np.ndarray, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH):
        self.ids, self.min_exp, self.min_length = ids, min_exp, min_length
        self.found: list[tuple[int, int, int]] = []

    def stretch(self, q: int) -> int:
        """Equal places that a run of period q has at least."""
        return max(self.min_length, self.min_exp * q) - q

    def lags(self, low: int, high: int) -> list[tuple[int, int, int]]:
        """Runs (start, length, period) with a period from `low` to below `high`, both ends of blocks."""
        n = len(self.ids)
        q = 1
        while q < min(high, n // self.min_exp + 1):
            if q < SMALL or q >= low:
                self._block(q, min(2 * q, n // self.min_exp + 1))
            q *= 2
        return [r for r in self.found if low <= r[2] < high]

    def _block(self, first: int, last: int) -> None:
        """Adds the runs of lags from `first` to below `last`, which is at most twice as much."""
        ids, n = self.ids, len(self.ids)
        least = self.stretch(first) if self.min_length <= self.min_exp * first else min(self.stretch(q) for q in range(first, last))
        step = max(1, least // 4)
        needed = least // step
        grid = np.arange(0, n - first, step)
        if len(grid) < needed:
            return
        padded = np.concatenate([ids, np.full(last, -1, ids.dtype)])
        hits: dict[int, list[np.ndarray]] = {}
        rows = max(needed, CELLS // (last - first))
        for at in range(0, len(grid) - needed + 1, rows):
            part = grid[at : at + rows + needed - 1]
            equal = padded[part[:, None] + np.arange(first, last)] == ids[part][:, None]
            row = equal[: len(part) - needed + 1].copy()
            for k in range(1, needed):
                row &= equal[k : len(part) - needed + 1 + k]
            where, lag = np.nonzero(row)
            if len(lag):
                order = np.argsort(lag, kind="stable")
                where, lag = where[order] + at, lag[order]
                cuts = np.flatnonzero(np.diff(lag)) + 1
                for w, q in zip(np.split(where, cuts), lag[np.concatenate([[0], cuts])].tolist()):
                    hits.setdefault(first + q, []).append(w)
        below = np.array(self.found, dtype=np.int64).reshape(-1, 3)
        for q in sorted(hits):
            where = np.unique(np.concatenate(hits[q]))
            cuts = np.flatnonzero(np.diff(where) > 1) + 1
            starts = np.maximum(grid[where[np.concatenate([[0], cuts])]] - step + 1, 0)
            ends = np.minimum(grid[where[np.concatenate([cuts - 1, [len(where) - 1]])] + needed - 1] + step, n - q)
            self._lag(q, starts.tolist(), ends.tolist(), below)

    def _lag(self, q: int, starts: list[int], ends: list[int], below: np.ndarray) -> None:
        """Adds the runs of one lag, whose stretches lie between these places."""
        ids = self.ids
        known = below[(q % below[:, 2] == 0) & (below[:, 1] > q)] if len(below) else below
        known = known[np.argsort(known[:, 0], kind="stable")]
        taken = list(zip(known[:, 0].tolist(), (known[:, 0] + known[:, 1] - q).tolist()))
        primes = _primes(q)
        k = 0
        for a, b in zip(starts, ends):
            # Places that a smaller period explains are whole stretches of this lag: they are left out.
            while k and taken[k - 1][1] > a:
                k -= 1
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            pieces, at, j = [], a, k
            while j < len(taken) and taken[j][0] < b:
                if taken[j][0] > at:
                    pieces.append((at, taken[j][0]))
                at, j = max(at, taken[j][1]), j + 1
            if at < b:
                pieces.append((at, b))
            for c, d in pieces:
                for s, e in _stretches(ids[c:d] == ids[c + q : d + q], self.stretch(q)):
                    x = ids[c + s : c + e + q]
                    if not any(self._has_period(x, q // r) for r in primes):
                        self.found.append((c + s, e - s + q, q))

    @staticmethod
    def _has_period(x: np.ndarray, p: int) -> bool:
        head = min(64, len(x) - p)
        return np.array_equal(x[:head], x[p : p + head]) and np.array_equal(x[p:], x[:-p])


def lag_ranges(n: int, min_exp: int = MIN_EXP, words: int = RANGE_WORDS) -> list[tuple[int, int]]:
    """Ranges of whole lag blocks that a text of n words is dealt in, one for each `words` words and block at most."""
    blocks = [1 << k for k in range(max(1, (n // min_exp).bit_length()))]
    size = math.ceil(len(blocks) / min(len(blocks), math.ceil(max(n, 1) / words)))
    return [(part[0], part[-1] * 2) for part in (blocks[i : i + size] for i in range(0, len(blocks), size))]


def _as_runs(rows: list) -> pa.Array:
    return pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in rows], _ARROW_RUNS)


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _dealt(long: DataFrame, text: str, min_exp: int, min_length: int, words: int) -> DataFrame:
    """Runs of long texts by __row, each range of lags in a row of its own."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column("__row").to_pylist(), batch.column(text).to_pylist()):
                ids = word_numbers(t.encode("utf-8").split())
                own = lag_ranges(len(ids), min_exp, words)
                for low, high in own:
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([low]), pa.array([high]), pa.array([ids.tobytes()], pa.binary())], names=["__row", "__low", "__high", "__ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = batch.column("__row"), []
            for low, high, ids in zip(*(batch.column(c).to_pylist() for c in ("__low", "__high", "__ids"))):
                found.append(Scan(np.frombuffer(ids, np.int32), min_exp, min_length).lags(low, high))
            yield pa.RecordBatch.from_arrays([rows, _as_runs(found)], names=["__row", "__found"])

    rows = long.select("__row", text).mapInArrow(ranges, "__row long, __low long, __high long, __ids binary").repartition("__row", "__low")
    found = rows.mapInArrow(scan, T.StructType([T.StructField("__row", T.LongType()), T.StructField("__found", RUNS)]))
    return found.groupBy("__row").agg(F.flatten(F.collect_list("__found")).alias("__found"))


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words", min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH, long_bytes: int = LONG_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """Adds the runs of every whole text by start and period, the text without repeated periods, and its words."""
    if min_exp < 2 or min_length < 2:
        raise ValueError("runs repeat twice or more and have two words or more")
    kept = docs.select([c for c in docs.columns if c not in (runs, collapsed, n_words)])
    is_long = F.coalesce(F.octet_length(text) > long_bytes, F.lit(False))
    long = saved(kept.where(is_long).withColumn("__row", F.monotonically_increasing_id()), "long-texts")
    given = long.join(_dealt(long, text, min_exp, min_length, range_words), "__row", "left").drop("__row").withColumn("__found", F.coalesce("__found", F.array().cast(RUNS)))
    rows = kept.where(~is_long).withColumn("__found", F.lit(None).cast(RUNS)).unionByName(given)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                size, found, left = [], [], []
                for t, known in zip(batch.column(text).to_pylist(), batch.column("__found").to_pylist()):
                    words = t.encode("utf-8").split() if t else []
                    if known is None:
                        own = Scan(word_numbers(words), min_exp, min_length).lags(1, len(words) + 1)
                    else:
                        own = [(r["start"], r["length"], r["period"]) for r in known]
                    own.sort(key=lambda r: (r[0], r[2]))
                    size.append(len(words))
                    found.append(own)
                    left.append(b" ".join(collapsed_words(words, own)).decode("utf-8"))
                columns = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), _as_runs(found), pa.array(left, pa.string())], names=schema.names)

    return rows.mapInArrow(apply, schema)


def planted(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts, those whose id has a CRC-32 divisible by 10 with a periodic tail: a rule that gives the tables runs of all sizes."""
    h = F.crc32(F.col(doc).cast("string"))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("__h", h).withColumn("__words", F.when(F.col("__h") % 10 == 0, words)).withColumn("__n", F.size("__words"))
    rows = rows.withColumn("__g", F.floor(F.col("__h") / 10))
    chosen = (F.col("__h") % 10 == 0) & (F.col("__n") > 0)
    rows = rows.withColumn("__a", F.when(chosen, F.col("__g") % F.col("__n")).cast("int"))
    rows = rows.withColumn("__p", F.when(chosen, 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__words", F.col("__a") + 1, F.col("__p")), F.ceil((F.col("__n") - F.col("__a")) / F.col("__p")).cast("int"))), F.lit(1), F.col("__n") - F.col("__a"))
    made = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    return rows.withColumn(text, F.when(chosen, made).otherwise(F.col(text))).select(docs.columns)


def _longest(field: str) -> Column:
    """A field of the longest run; of equally long ones the first, then that with the smallest period."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return best["length"] if field == "length" else -best[field]


def period_digests(docs: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest one, digests of all runs and of the collapsed text."""
    found = periodic_runs(planted(docs.select("doc_id", "text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[_longest(f).alias(f) for f in ("start", "length", "period")], F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).withColumn("exponent_milli", F.expr("(1000 * length) div period")).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
