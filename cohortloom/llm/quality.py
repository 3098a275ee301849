"""Quality rules with compression bands.

Base measures: words, their code points, symbols, lines that repeat an earlier line, and words inside 3-word windows
found twice or more. A text fails the base below 50 words or when over half of its words are in repeated windows.

The method: zstandard at a fixed level over the whole text and over fixed chunks. Repetitive text compresses far more
than prose of its length and noise hardly at all, so each length class has its own band of bytes in per byte out; a
text outside its band, or with more than `BAD_CHUNKS` of its bytes in chunks outside theirs, is rejected. The last chunk
is what the others leave, at any length, and has the least ratio of its own length class.

Noise over few characters (hexadecimal, digits, base32, letters) compresses by its alphabet alone and as well as prose
does, so a ratio can't tell it. What can is the order of the characters: the same characters in a fixed random order are
the measure of what the alphabet gives. `gain` is their zstandard size over that of the text, `pairs` their number of
distinct neighbouring pairs over that of the text; both are 1 for noise of every alphabet, up to 1.02 and 1.12 measured
from 512 bytes on, while the tables' clean texts have 1.33 pairs from 512 bytes on (1.54 from 2 KB) and a gain of 1.08 from 2 KB on
(1.13 from 4 KB) at least. Pairs also tell short texts, where zstandard has little to match; they say nothing of a text whose
characters are nearly all different, so it isn't judged by them. Both are measured by chunk, and reported as the least of a
text's chunks: a text whose chunks are all without order is incompressible, one with more than half such bytes goes too.

A map over rows without a shuffle. Defined results: a null or empty text has no words and fails; repeated rows repeat; an
empty table gives no rows. Other columns pass through `quality_rules`, except one named as its struct; the report reads
no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEVEL = 3
CHUNK = 4096
BAD_CHUNKS = 0.5
# Least bytes of a class, and the least and largest ratio (bytes in / bytes out) that it keeps.
BANDS = [(0, 0.0, 6.0), (128, 1.05, 6.0), (256, 1.23, 6.0), (512, 1.31, 6.0), (1024, 1.45, 6.0), (2048, 1.5, 7.0), (8192, 1.5, 8.0), (65536, 1.5, 10.0)]
CHUNK_MOST = 8.0
# Both measures of order have a least value from a number of bytes on; pairs only with `ALPHABET` characters a distinct one.
PAIRS = [(0, 0.0), (256, 1.17), (512, 1.2)]
GAINS = [(0, 0.0), (2048, 1.03), (4096, 1.05)]
ALPHABET = 4

_WHITE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def band(size: int) -> tuple[float, float]:
    """The least and largest ratio of a text of that many bytes."""
    return next((a, b) for least, a, b in reversed(BANDS) if size >= least)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    slots: dict[bytes, int] = {}
    ids = np.array([slots.setdefault(w, len(slots)) for w in words], dtype=np.int64)
    m = len(slots)
    pairs = ids[:-2] * m + ids[1:-1]
    if m > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


class Rules:
    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.packer.compress(data)) if data else 0.0

    def order(self, data: bytes) -> tuple[float, float]:
        """How many times fewer pairs, and how many times less space, the text takes than its characters in a fixed random order."""
        codes = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(codes) < 2:
            return 1.0, 1.0
        mixed = np.random.Generator(np.random.PCG64(len(codes))).permutation(codes)
        letters = np.flatnonzero(np.bincount(codes))
        m = len(letters)
        pairs = float("inf")
        if m * ALPHABET <= len(codes):
            number = np.zeros(int(letters[-1]) + 1, np.int64)
            number[letters] = np.arange(m)
            distinct = lambda x: np.count_nonzero(np.bincount(x[:-1] * m + x[1:])) if m <= 2048 else len(np.unique(x[:-1] * m + x[1:]))
            pairs = distinct(number[mixed]) / distinct(number[codes])
        gain = float("inf")
        if len(data) >= GAINS[1][0]:
            gain = len(self.packer.compress(mixed.tobytes().decode("utf-32-le").encode())) / len(self.packer.compress(data))
        return pairs, gain

    @staticmethod
    def disordered(size: int, pairs: float, gain: float) -> bool:
        return any(value < next(least for start, least in reversed(limits) if size >= start) for value, limits in ((pairs, PAIRS), (gain, GAINS)))

    def measure(self, text: str | None) -> tuple:
        text = text or ""
        data = text.encode("utf-8")
        words = data.split()
        seen: set[bytes] = set()
        dup_lines = 0
        if b"\n" in data:
            for line in data.split(b"\n"):
                if line in seen:
                    dup_lines += 1
                elif line.strip(_WHITE):
                    seen.add(line)
        n, repeat = len(words), repeated_words(words)
        failed = n < 50 or 100 * repeat > 50 * n
        whole = self.ratio(data)
        low, high = band(len(data))
        chunks, orders, noise = [], [], 0
        for piece in (data[i : i + CHUNK] for i in range(0, len(data), CHUNK)):
            r = self.ratio(piece)
            orders.append(self.order(piece))
            disordered = self.disordered(len(piece), *orders[-1])
            noise += disordered * len(piece)
            chunks.append((len(piece), r > CHUNK_MOST or r < band(len(piece))[0] or disordered))
        pairs, gain = (min((o[k] for o in orders if o[k] < float("inf")), default=None) for k in (0, 1))
        # The last chunk may be too short to be told.
        told = sum(size for size, _ in chunks if size >= PAIRS[1][0])
        disordered = 0 < told == noise
        bad = sum(out for _, out in chunks)
        bad_bytes = sum(size for size, out in chunks if out)
        reason = "base" if failed else "repetitive" if whole > high else "incompressible" if whole < low or disordered else "chunks" if bad_bytes > BAD_CHUNKS * len(data) else None
        return (n, len(text) - len(data) + len(data.translate(None, _WHITE)), len(data) - len(data.translate(None, _SYMBOLS)), dup_lines, repeat, failed, reason is None, whole, bad, len(chunks), reason, pairs, gain)


ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("ratio", T.DoubleType()), T.StructField("bad_chunks", T.LongType()),
    T.StructField("chunks", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("pairs", T.DoubleType()),
    T.StructField("gain", T.DoubleType()),
])
_ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]


def quality_rules(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """Adds one struct column with the measures, the ratios, the verdict `kept` and the reason of a rejection."""
    rest = docs.select([c for c in docs.columns if c != into])
    schema = T.StructType([*rest.schema.fields, T.StructField(into, ADDED)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules()
        for batch in batches:
            rows = [rules.measure(t) for t in batch.column(text).to_pylist()]
            columns = zip(*rows) if rows else [[]] * len(_ARROW)
            made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _ARROW)], names=ADDED.names)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return rest.mapInArrow(apply, schema)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, whether the base failed, the verdict and the ratios behind it."""
    return quality_rules(docs.select("doc_id", "text")).select("doc_id", "quality.*")
