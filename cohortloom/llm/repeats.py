"""Removal of repeated 50-byte strings by hashed windows behind a difference cover filter; no suffix array is built.

Every suffix (a position of a text, taken to 50 bytes) would be too much to sort at once, so:

1. Texts are dealt by ranges of doc_id into chunks of about `CHUNK` bytes, written once to the shared folder. A smaller
   chunk number means smaller ids, so "an earlier document" is an earlier chunk, or an earlier place in the same chunk.
2. Cover samples: positions whose residue modulo 31 is in the difference cover {0, 1, 3, 8, 12, 18}. For any two
   positions there is a shift below 31 that takes both into the cover, so two equal 50-byte strings hold two equal
   sample blocks of 20 bytes at one such shift. Each chunk sorts the names of its blocks and sends each name once, in
   buckets of names; a bucket's task sorts that bucket and ranks a name as unique or repeated over the chunks.
3. Suffixes without a repeated sample block in reach can have no match and drop out. The others go in blocks by a
   hash of their first bytes, one block after the other, and are named by their 50 bytes (64-bit names), again once per chunk and
   bucket; one bucket at a time is sorted, and long ties - a name
   that many chunks hold - are resolved by the chunk's rank: all but the first chunk learn that an earlier one has it.
4. Each chunk marks the suffixes that start earlier elsewhere, or in an earlier document of its own, and covers them.

What travels is one name per chunk and bucket, so a string that a third of all documents hold costs one row entry per
chunk. A task holds one chunk or one bucket (`CHUNK` bytes of text, or the names of about as many); both counts grow
with the input. Two different strings get one name with a probability of 2**-64 a pair.

Defined results: a null or empty text has no bytes and keeps the digest of nothing; texts under 50 bytes stay whole;
rows with one doc_id (repeated rows) are not earlier than one another; null ids come after all others; an empty table
gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import dropped, saved, total_bytes

LENGTH = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
SAMPLE = LENGTH - PERIOD + 1
CHUNK = 6 << 20
BLOCKS = 2

_CHUNKS = "chunk long, ids array<long>, sizes array<int>, blob binary"
_NAMES = "bucket long, chunk long, n int, names binary"


def _words(blob: bytes, n: int) -> np.ndarray:
    """The 8 bytes from each position as one number, as an aligned array."""
    padded = np.zeros(n + 64, dtype=np.uint8)
    padded[:n] = np.frombuffer(blob, dtype=np.uint8)
    return np.array(np.ndarray(shape=(n + 56,), dtype="<u8", buffer=padded.data, strides=(1,)))


def _names(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name of the `length` bytes at each place."""
    x = np.full(len(at), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        x ^= words[at + k]
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(29)
    return x


def _packed(names: np.ndarray) -> bytes:
    """Sorted names as differences, byte plane by byte plane: small differences cost few bytes."""
    gaps = np.diff(names, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _edges(buckets: int) -> np.ndarray:
    """The least name of each bucket."""
    return np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)


def _by_bucket(names: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the sorted names."""
    cuts = np.append(np.searchsorted(names, _edges(buckets)), len(names))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), int(cuts[b]), int(cuts[b + 1])


def _distinct(names: np.ndarray) -> np.ndarray:
    names = np.sort(names)
    return names[np.concatenate([[True], names[1:] != names[:-1]])] if len(names) else names


def _repeated(names: np.ndarray) -> np.ndarray:
    """The names that are there twice or more."""
    names = np.sort(names)
    return _distinct(names[1:][names[1:] == names[:-1]])


def _among(names: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which names are among the sorted `some`; a table of folded names rules most of the others out first."""
    found = np.zeros(len(names), dtype=bool)
    if not len(some) or not len(names):
        return found
    if len(names) < 1 << 16:
        at = np.minimum(np.searchsorted(some, names), len(some) - 1)
        return some[at] == names
    fold = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
    there = np.zeros(1 << 22, dtype=bool)
    there[fold(some)] = True
    maybe = np.flatnonzero(there[fold(names)])
    asked = names[maybe]
    at = np.minimum(np.searchsorted(some, asked), len(some) - 1)
    found[maybe] = some[at] == asked
    return found


class Chunk:
    """The texts of a chunk, one after the other, as bytes."""

    def __init__(self, ids: list, sizes: list[int], blob: bytes):
        self.ids, self.blob = ids, blob
        self.sizes = np.array(sizes, dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.n = int(self.ends[-1]) if len(self.ends) else 0
        self.words = _words(blob, self.n)

    def inside(self, length: int) -> np.ndarray:
        """Whether `length` bytes from each position are in one text."""
        ok = np.ones(self.n, dtype=bool)
        for end, size in zip(self.ends.tolist(), self.sizes.tolist()):
            ok[end - min(size, length - 1) : end] = False
        return ok

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cover's samples and their names, shortened to 48 bits (they only rule suffixes out)."""
        at = (np.arange(0, self.n, PERIOD, dtype=np.int64)[:, None] + np.array(COVER)).ravel()
        at = at[at < self.n]
        at = at[self.inside(SAMPLE)[at]]
        return at, _names(self.words, at, SAMPLE) >> np.uint64(16) << np.uint64(16)

    def suffixes(self, shared: list[dict] | None, buckets: int) -> np.ndarray:
        """Places of the 50-byte strings that hold a sample repeated here or elsewhere."""
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        at, names = self.samples()
        hit = _among(names, _flagged(_distinct(names), shared, buckets)) | _among(names, _repeated(names))
        count = np.zeros(self.n + LENGTH, dtype=np.int32)
        count[at[hit]] = 1
        np.cumsum(count, out=count)
        reach = LENGTH - SAMPLE
        near = count[reach : reach + self.n].copy()
        near[1:] -= count[: self.n - 1]
        return np.flatnonzero((near > 0) & self.inside(LENGTH))

    def block_of(self, places: np.ndarray, blocks: int) -> np.ndarray:
        """The block of each suffix, by its first bytes."""
        return ((self.words[places] * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(40)) % np.uint64(blocks)

    def results(self, places: np.ndarray, names: np.ndarray, earlier: np.ndarray) -> Iterator[tuple]:
        """(doc_id, n_bytes, n_removed, n_spans, kept bytes) of each text."""
        start = _among(names, earlier)
        own = np.flatnonzero(_among(names, _repeated(names)))
        if len(own):
            order = own[np.argsort(names[own], kind="stable")]
            text = np.searchsorted(self.ends, places[order], side="right")
            # Texts with one id count as one.
            same = np.concatenate([[0], np.cumsum([a != b for a, b in zip(self.ids[1:], self.ids[:-1])])])
            text = same[text]
            new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
            first = text[np.flatnonzero(new)][np.cumsum(new) - 1]
            start[order[text > first]] = True
        count = np.zeros(self.n + 1, dtype=np.int32)
        count[places[start] + 1] = 1
        np.cumsum(count, out=count)
        covered = count[1:].copy()
        if self.n > LENGTH:
            covered[LENGTH:] -= count[1 : self.n - LENGTH + 1]
        covered = covered > 0
        data = np.frombuffer(self.blob, dtype=np.uint8)
        for doc, end, size in zip(self.ids, self.ends.tolist(), self.sizes.tolist()):
            mine = covered[end - size : end]
            removed = int(mine.sum())
            if not removed:
                yield doc, size, 0, 0, self.blob[end - size : end]
            else:
                spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
                yield doc, size, removed, spans, data[end - size : end][~mine].tobytes()


def _chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    total = total_bytes(docs, "text")
    parts = max(1, math.ceil(total / chunk_bytes))
    order = F.col("doc_id").asc_nulls_last()
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, order).sortWithinPartitions(order)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        held, made, part = 0, 0, TaskContext.get().partitionId()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([b"".join(texts)], pa.binary())], names=["chunk", "ids", "sizes", "blob"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if held >= chunk_bytes and doc != ids[-1]:
                    yield row()
                    ids, texts, held, made = [], [], 0, made + 1
                ids.append(doc)
                texts.append(text or b"")
                held += len(texts[-1])
        if ids:
            yield row()

    return saved(dealt.mapInArrow(apply, _CHUNKS), "chunks"), total


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _flagged(names: np.ndarray, marks: list[dict] | None, buckets: int) -> np.ndarray:
    """Of the sorted names that were sent, those whose bits came back set."""
    bits = {m["bucket"]: m["bits"] for m in marks or []}
    found = [names[at:to][np.unpackbits(np.frombuffer(bits[b], dtype=np.uint8), count=to - at).astype(bool)] for b, at, to in _by_bucket(names, buckets) if b in bits]
    return np.concatenate(found) if found else names[:0]


def _sorted_buckets(names: DataFrame, first_stays: bool, what: str) -> DataFrame:
    """Sort one bucket of names at a time; tell each chunk, a bit a name, which of its names other chunks hold (first_stays: earlier ones)."""

    def bucket(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_numpy()
        order = np.argsort(chunks, kind="stable").tolist()
        sizes, packed = table.column("n"), table.column("names")
        each = [(int(chunks[i]), _unpacked(packed[i].as_py(), sizes[i].as_py())) for i in order]
        shared = _repeated(np.concatenate([x for _, x in each]))
        seen = np.zeros(len(shared), dtype=bool)
        out = []
        for chunk, own in each:
            flags = _among(own, shared)
            if first_stays:
                at = np.searchsorted(shared, own[flags])
                flags[flags] = seen[at]
                seen[at] = True
            if flags.any():
                out.append((chunk, np.packbits(flags).tobytes()))
        number = table.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "bucket": pa.array([number] * len(out), pa.int64()), "bits": pa.array([x for _, x in out], pa.binary())})

    return saved(names.groupBy("bucket").applyInArrow(bucket, "chunk long, bucket long, bits binary"), what)


def _with_marks(chunks: DataFrame, marks: DataFrame, field: str) -> DataFrame:
    by = marks.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in marks.columns if c != "chunk"])).alias(field))
    return chunks.join(by, "chunk", "left")


def _sent(chunk: int, names: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    rows = [(b, chunk, to - at, _packed(names[at:to])) for b, at, to in _by_bucket(names, buckets)]
    if rows:
        columns = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "chunk", "n", "names"])


def without_repeats(docs: DataFrame, chunk_bytes: int = CHUNK, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every whole text."""
    chunks, total = _chunked(docs, chunk_bytes)
    buckets = max(1, math.ceil(total / chunk_bytes))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                yield from _sent(row["chunk"], _distinct(Chunk(row["ids"], row["sizes"], row["blob"]).samples()[1]), buckets)

    def suffixed(block: int):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _each(batch):
                    chunk = Chunk(row["ids"], row["sizes"], row["blob"])
                    places = chunk.suffixes(row["shared"], buckets)
                    places = places[chunk.block_of(places, blocks) == block]
                    yield from _sent(row["chunk"], _distinct(_names(chunk.words, places, LENGTH)), buckets)

        return apply

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                chunk = Chunk(row["ids"], row["sizes"], row["blob"])
                places = chunk.suffixes(row["shared"], buckets)
                names, of = _names(chunk.words, places, LENGTH), chunk.block_of(places, blocks)
                earlier = [_flagged(_distinct(names[of == k]), [m for m in row["earlier"] or [] if m["block"] == k], buckets) for k in range(blocks)]
                rows = list(chunk.results(places, names, np.sort(np.concatenate(earlier))))
                for at in range(0, len(rows), 1000):
                    columns = zip(*rows[at : at + 1000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    shared = _sorted_buckets(chunks.mapInArrow(sampled, _NAMES), False, "shared")
    marked = saved(_with_marks(chunks, shared, "shared"), "marked")
    dropped(chunks)
    # One block of suffixes at a time: its names are dealt, sorted and forgotten before the next one's are made.
    earlier = None
    for block in range(blocks):
        found = _sorted_buckets(marked.mapInArrow(suffixed(block), _NAMES), True, "earlier").withColumn("block", F.lit(block))
        earlier = found if earlier is None else earlier.unionByName(found)
    return _with_marks(marked, earlier, "earlier").mapInArrow(finished, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
