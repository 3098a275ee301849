"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits that differ in at most `RADIUS` = 3 bits differ in at most one bit in one of their halves
(half the radius, rounded down). So every distinct fingerprint emits, for both halves, all variants within half the
radius - the half itself and each of its 32 one-bit flips - and rows meet on (half, variant). Both sides emit, so two
texts meet even if the half differs in two bits, which is why the same keys serve a radius of up to 5. Rows are sorted
by key inside shuffle partitions and streamed; colliding pairs are verified on all 64 bits, and only the edges of a
spanning forest of each group leave it, never all pairs. Copies are grouped to one fingerprint before anything is
emitted, so a group of copies of any size costs one row.

Components are found by alternating large-star and small-star rounds over the edges, each round written to the shared
folder. Nothing is collected.

Defined results: texts without words (null, empty, blank) have fingerprint zero and are linked like any others;
a null doc_id takes no part in the smallest id unless all of a component's ids are null; repeated rows are repeated; an
empty table gives no rows. Only doc_id and text are read, so other columns can't clash; `fingerprints` passes them through,
except one named as its output, and `without_near_duplicates` returns the columns it was given.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cohortloom.llm.common import dropped, saved

RADIUS = 3
SEED = 42
# Words of a shingle of a fingerprint.
WORDS = 3
BLOCK = 512
# Members of a key that are compared in one block; a larger key is dealt out in pairs of blocks.
MEMBERS = 4096
# Near-duplicates: one text in SAMPLE is read for the COMMON most common shingles; members of a key that meet in one block.
SAMPLE, COMMON, TILE = 16, 200_000, 512
# Parts into which the texts of a common shingle are dealt; rounds of ties before all other pairs are compared; classes of a small sketch.
SALTS, ROUNDS, SKETCH = 64, 3, 64
# Rows of numbers that may be broadcast once they have been counted.
BROADCAST_ROWS = 2_000_000
# Pairs of one text beyond which they are dealt to several tasks.
HUB = 4096

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words as UTF-8; words are runs without ASCII white space."""
    return (text or "").encode("utf-8").translate(_LOWER).split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if not words:
        return []
    if size == 1 or len(words) < size:
        return words if size == 1 else [b" ".join(words)]
    return [b" ".join(x) for x in zip(*[words[k:] for k in range(size)])]


def hashes(parts: list[bytes], seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in parts), dtype=np.uint64, count=len(parts))


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: zero."""
    if not len(h):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = WORDS, into: str = "fp") -> DataFrame:
    """Adds the fingerprint (long, the 64 bits as they are) of every whole text over shingles of `size` words, repeats included."""
    rest = docs.select([c for c in docs.columns if c != into])
    schema = T.StructType([*rest.schema.fields, T.StructField(into, T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(hashes(shingles(words_of(t), size))) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(made, dtype=np.uint64).view(np.int64))], names=schema.names)

    return rest.mapInArrow(apply, schema)


def ball_keys(nodes: DataFrame, fp: str, *carried: str) -> DataFrame:
    """(key, carried...) of every variant of both halves within half the radius; 66 rows for a fingerprint."""
    flips = [0, *(1 << b for b in range(32))]
    masks = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(x).cast("long").alias("x")) for h in (0, 1) for x in flips])
    rows = nodes.select(fp, *carried, F.explode(masks).alias("__m"))
    half = F.when(F.col("__m.h") == 0, F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(F.col(fp), 32))
    # The half's number goes above the 32 bits of the variant.
    return rows.select((half.bitwiseXOR(F.col("__m.x")) + F.col("__m.h").cast("long") * F.lit(1 << 32)).alias("__key"), *carried)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _forest(radius: int, node: np.ndarray, check: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the graph of members within `radius`; rows of blocks, not all pairs, are held."""
    n = len(node)
    root = np.arange(n)
    a, b = [], []
    for at in range(0, n, BLOCK):
        rows = slice(at, min(n, at + BLOCK))
        near = _distances(check[rows, None], check[None, :]) <= radius
        for i, line in enumerate(near, at):
            other = np.flatnonzero(line[:i])
            if len(other):
                roots = np.unique(root[other])
                for r in roots[roots != root[i]]:
                    j = other[root[other] == r][0]
                    a.append(node[i])
                    b.append(node[j])
                low = min(int(roots[0]), int(root[i]))
                root[np.isin(root, np.append(roots, root[i]))] = low
    return [(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))] if a else []


def large_keys(nodes: DataFrame, fp: str, most: int = MEMBERS) -> DataFrame:
    """(__key, __blocks) of the keys of `ball_keys` that may have more than `most` members; all others have no more.

    A key's members have one of 33 halves, so it is large only if one of these halves is: only such halves are flipped.
    """
    half = F.array(F.struct(F.lit(0).alias("h"), F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")), F.struct(F.lit(1).alias("h"), F.shiftrightunsigned(F.col(fp), 32).alias("v")))
    counts = nodes.select(F.explode(half).alias("x")).select("x.h", "x.v").groupBy("h", "v").agg(F.count(F.lit(1)).alias("c"))
    # Halves below this add up to `most` members at most.
    heavy = counts.where(F.col("c") > most // 33)
    flip = F.explode(F.array(*[F.lit(x).cast("long") for x in (0, *(1 << b for b in range(32)))]))
    made = heavy.select("h", "v", "c", flip.alias("x"))
    made = made.select((F.col("v").bitwiseXOR(F.col("x")) + F.col("h").cast("long") * F.lit(1 << 32)).alias("__key"), "c").groupBy("__key").agg(F.sum("c").alias("c"))
    return made.select("__key", F.ceil((F.col("c") + most) / most).cast("int").alias("__blocks"))


def dealt_keys(keys: DataFrame, large: DataFrame) -> DataFrame:
    """The keys with members of a large key under a number for each pair of blocks, so that any two members meet in one."""
    at = F.pmod(F.xxhash64("__node", F.lit(1)), "__blocks").cast("int")
    whole = keys.join(large, "__key", "left")
    tiled = whole.where("__blocks > 1").withColumn("__at", at).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).where("__other <> __at")
    tile = F.least("__at", "__other") * F.col("__blocks").cast("long") + F.greatest("__at", "__other")
    # Numbers of tiles lie below zero, where no key of one half and variant is.
    tiled = tiled.withColumn("__key", F.xxhash64("__key", tile).bitwiseOR(F.lit(-(1 << 63))))
    return whole.where("__blocks is null or __blocks < 2").select(keys.columns).unionAll(tiled.select(keys.columns))


def colliding_edges(keys: DataFrame, radius: int) -> DataFrame:
    """Edges (a > b) of a spanning forest of the members of each key; keys: (__key, __node, __check).

    Members with one node and key are one. A key's members are distinct fingerprints of one 32-bit variant, or those of
    two blocks of them (`dealt_keys`), so what a task holds at a time are these, some 16 bytes each.
    """
    columns = keys.columns
    dealt = keys.repartition("__key").sortWithinPartitions("__key")

    def groups(key: np.ndarray, *members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        # Most keys have two members or less: those out of reach go before any key is looked at by itself.
        two = start[size == 2]
        near = _distances(members[1][two], members[1][two + 1]) <= radius
        many = size > 2
        alone = two[near]
        yield members[0][alone], members[0][alone + 1]  # two within reach are an edge as they are
        for s, n in zip(start[many], size[many]):
            picked, at = np.unique(members[0][s : s + n], return_index=True)
            if len(picked) > 1:
                yield from _forest(radius, picked, *[m[s : s + n][at] for m in members[1:]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def made(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            key, node, check, *more = (np.concatenate(x) for x in zip(*parts))
            edges = list(groups(key, node, check.view(np.uint64), *more))
            if edges:
                a, b = (np.concatenate(x) for x in zip(*edges))
                a, b = np.maximum(a, b), np.minimum(a, b)
                both = np.unique(np.stack([a, b])[:, a != b], axis=1)
                if both.size:
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, *members = (batch.column(c).to_numpy(zero_copy_only=False) for c in columns)
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                yield from made([*held, (key[:cut], *[m[:cut] for m in members])])
                held = []
            elif held and held[0][0][0] != key[0]:
                yield from made(held)
                held = []
            held.append((key[cut:], *[m[cut:] for m in members]))
        if held:
            yield from made(held)

    return dealt.mapInArrow(apply, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b); nodes without an edge are not listed.

    Large-star: every node's larger neighbours are tied to its smallest neighbour (itself included); small-star: a node and
    its smaller neighbours are tied to the smallest. Both keep the components; they end when no edge changes.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(tied.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = saved(small, "edges")
        seen = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        dropped(now)
        now = after
        if not seen["n"] or mark == tuple(seen):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def print_links(nodes: DataFrame, fp: str = "fp", radius: int = RADIUS, most: int = MEMBERS) -> DataFrame:
    """Edges (a > b) between distinct fingerprints within `radius` bits that connect all that are within it."""
    if not 0 <= radius <= 5:
        raise ValueError("two halves serve a radius of 0 to 5")
    keys = ball_keys(nodes.select(fp, F.col(fp).alias("__node"), F.col(fp).alias("__check")), fp, "__node", "__check")
    large = saved(large_keys(nodes, fp, most), "large")
    if large.limit(1).count():
        keys = dealt_keys(keys, large)
    return saved(colliding_edges(keys, radius), "links")


def linked(prints: DataFrame, fp: str = "fp", doc: str = "doc_id", radius: int = RADIUS, most: int = MEMBERS) -> DataFrame:
    """Adds component_id: the smallest doc reachable over fingerprints within `radius` bits."""
    nodes = saved(prints.groupBy(fp).agg(F.min(doc).alias("__least")), "fingerprints")
    rooted = components(print_links(nodes, fp, radius, most))
    whole = nodes.join(rooted, nodes[fp] == rooted["node"], "left").select(nodes[fp], "__least", F.coalesce("root", nodes[fp]).alias("__root"))
    least = whole.groupBy("__root").agg(F.min("__least").alias("component_id"))
    ids = whole.join(least, "__root").select(fp, "component_id")
    return prints.join(ids, fp, "left")


def _common_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Hashes of shingles that many texts hold, the most common last; from one text in SAMPLE, COMMON at most.

    They only set the order in which the search below reads shingles: whichever they are, no pair is lost.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(shingles(words_of(text), size))).view(np.int64))], names=["h"])

    counts = texts.where(F.pmod("node", F.lit(SAMPLE)) == 0).select("text").mapInArrow(each, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    most = counts.where("c >= 4").orderBy(F.desc("c"), "h").limit(COMMON).collect()
    return np.array([r["h"] for r in reversed(most)], dtype=np.int64).view(np.uint64)


def shared_prefixes(texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """(key, node, n, at, common): the first n - ceil(similarity * n) + 1 of the n shingles of a text in one order for all texts.

    Two sets with a Jaccard similarity of at least `similarity` share ceil(similarity * n) shingles or more of each, so
    the first one they share, in any order that is the same for both, is among these of both. Rare shingles come first.
    """
    common = _common_shingles(texts, size)
    by_hash = np.argsort(common)
    sorted_common = common[by_hash]

    def prefix(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(parts)
        count = n - math.ceil(similarity * n - 1e-9) + 1
        if not len(sorted_common):
            return parts[:count], np.zeros(count, dtype=bool)
        at = np.minimum(np.searchsorted(sorted_common, parts), len(sorted_common) - 1)
        rank = np.where(sorted_common[at] == parts, by_hash[at] + 1, 0)
        first = np.argsort(rank, kind="stable")[:count]
        return parts[first], rank[first] > 0

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(nodes: list, sizes: list, keys: list) -> pa.RecordBatch:
            counts = [len(k) for k, _ in keys]
            at = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
            columns = [np.concatenate([k for k, _ in keys]).view(np.int64), np.repeat(np.array(nodes, dtype=np.int64), counts), np.repeat(np.array(sizes, dtype=np.int32), counts), at, np.concatenate([c for _, c in keys])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n", "at", "common"])

        for batch in batches:
            nodes, sizes, keys, held = [], [], [], 0
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                parts = np.unique(hashes(shingles(words_of(text), size)))
                if len(parts):
                    nodes.append(node)
                    sizes.append(len(parts))
                    keys.append(prefix(parts))
                    held += len(keys[-1][0])
                if held > 200_000:
                    yield made(nodes, sizes, keys)
                    nodes, sizes, keys, held = [], [], [], 0
            if keys:
                yield made(nodes, sizes, keys)

    return texts.select("node", "text").mapInArrow(apply, "key long, node long, n int, at int, common boolean")


def shared_keys(prefixes: DataFrame) -> DataFrame:
    """(key, node, n, at) of the keys that two texts or more have, in one shuffle: most keys are one text's alone.

    Keys that are common by the sample pass as they are and are dealt by text, so none of them is one task's.
    """
    part = F.when(F.col("common"), F.xxhash64("key", F.pmod("node", F.lit(SALTS)))).otherwise(F.col("key"))
    dealt = prefixes.withColumn("__part", part).repartition("__part").drop("__part").sortWithinPartitions("key")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "n", "at"]

        def kept(columns: list[np.ndarray], before: int | None, after: int | None) -> pa.RecordBatch:
            key = columns[0]
            same = key[1:] == key[:-1]
            keep = columns[4] | np.append(same, key[-1] == after if after is not None else False) | np.append(key[0] == before if before is not None else False, same)
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns[:4]], names=names)

        held, before = None, None
        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if held is not None:
                    yield kept(held, before, columns[0][0])
                    before = held[0][-1]
                held = columns
        if held is not None:
            yield kept(held, before, None)

    return dealt.mapInArrow(apply, "key long, node long, n int, at int")


def _may_be_alike(n: Column, at: Column, n2: Column, at2: Column, similarity: float) -> Column:
    """The first shingle that two texts share leaves them no more in common than follows it in either."""
    return F.least(n - at, n2 - at2) * (1 + similarity) + 1e-6 >= similarity * (n + n2)


def across_pairs(members: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """(a, b), a > b, of members (key, node, n, at, root) of one key and different roots whose sizes and places allow the similarity.

    A key with more than `tile` members is cut into blocks of about that size; two blocks at a time meet under a key of
    their own, so no task holds a whole group.
    """
    some = members.groupBy("key").agg(F.count(F.lit(1)).alias("__c"), F.min("root").alias("__low"), F.max("root").alias("__high")).where("__low < __high")
    blocks = F.ceil(F.col("__c") / tile).cast("int")
    dealt = members.join(some.select("key", blocks.alias("__blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(tile)), "__blocks").cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "__other").alias("i"), F.greatest("block", "__other").alias("j"), "node", "n", "at", "root", "block")
    a, b = dealt.alias("x"), dealt.alias("y")
    may = _may_be_alike(*[F.col(c) for c in ("x.n", "x.at", "y.n", "y.at")], similarity)
    met = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "i", "j")]
    apart = (F.col("x.block") != F.col("y.block")) == (F.col("x.i") != F.col("x.j"))
    on = met[0] & met[1] & met[2] & apart & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & may
    return a.join(b, on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def key_ties(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a > b: the first text of every root of a key with the first of the key; members: (key, node, n, at, root).

    The first text of a key has it furthest to the front of its prefix, so it has the fewest shingles of its own: of a
    family of copies it is the one that is nearest to what they all come from. As many pairs as keys have roots.
    """
    firsts = members.groupBy("key", "root").agg(F.min(F.struct("at", "node", "n")).alias("own"))
    best = firsts.groupBy("key").agg(F.min("own").alias("best"), F.count(F.lit(1)).alias("__c")).where("__c > 1")
    met = firsts.join(best, "key").where(F.col("own.node") != F.col("best.node"))
    met = met.where(_may_be_alike(*[F.col(c) for c in ("own.n", "own.at", "best.n", "best.at")], similarity))
    return met.select(F.greatest("own.node", "best.node").alias("a"), F.least("own.node", "best.node").alias("b")).distinct()


def _sketch(parts: np.ndarray) -> bytes | None:
    """How many of the hashes fall into each of SKETCH classes, or of sixteen times as many for large sets.

    None for empty sets and for those that a byte a class might not count.
    """
    classes = SKETCH if len(parts) < 4 * SKETCH else 16 * SKETCH
    counts = np.bincount((parts % np.uint64(classes)).astype(np.int64), minlength=classes)
    return counts.astype(np.uint8).tobytes() if len(parts) and counts.max() < 256 else None


def _shared_at_most(a: bytes, b: bytes) -> int:
    """Two sets share no more than the lesser count of each class, whatever they hold; finer classes add up to coarser ones."""
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in (a, b))
    if len(x) != len(y):
        x, y = (v.reshape(-1, SKETCH).sum(axis=0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum(dtype=np.int64))


def hubs_of(pairs: DataFrame, most: int = HUB) -> DataFrame | None:
    """(node, salts) of nodes in more than `most` pairs, as the text that a family of copies is tied to; None if there are none."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    many = saved(ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("node", F.ceil(F.col("n") / most).cast("int").alias("salts")), "hubs")
    return many if many.limit(1).count() else None


def joined_end(pairs: DataFrame, end: str, side: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """pairs joined with `side` (node and more columns) on one end. A hub's pairs are dealt to as many tasks as it has salts, its row to each."""
    named = side.withColumnRenamed("node", end)
    if hubs is None:
        return pairs.join(named, end)
    hubs = F.broadcast(hubs) if hubs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hubs
    known = hubs.withColumnRenamed("node", end).withColumnRenamed("salts", "__salts")
    salts = F.coalesce("__salts", F.lit(1))
    dealt = pairs.join(known, end, "left").withColumn("__salt", F.pmod(F.xxhash64("a", "b"), salts).cast("int")).drop("__salts")
    sent = named.join(known, end, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(sent, [end, "__salt"]).drop("__salt")


def _within_sketches(pairs: DataFrame, sketches: DataFrame, similarity: float, hubs: DataFrame | None = None) -> DataFrame:
    """The pairs whose sketches allow the similarity."""
    one = lambda end: sketches.select("node", F.col("sketch").alias(f"s{end}"), F.col("n").alias(f"n{end}"))
    both = joined_end(joined_end(pairs, "a", one("a"), hubs), "b", one("b"), hubs).select("a", "b", "sa", "sb", "na", "nb")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb, na, nb in zip(*[batch.column(k).to_pylist() for k in range(2, 6)]):
                most = min(na, nb) if sa is None or sb is None else _shared_at_most(sa, sb)
                keep.append(most + 1e-6 >= similarity * (na + nb - most))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(apply, "a long, b long")


def with_prints(texts: DataFrame, size: int) -> DataFrame:
    """Adds n, the number of a text's distinct shingles of `size` words, their sketch, and fp, its fingerprint.

    All in one map, so that a task has one Python worker for them, and not one for each.
    """
    schema = T.StructType([*texts.schema.fields, T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("fp", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sketches, prints = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                parts = np.unique(hashes(shingles(words, size)))
                counts.append(len(parts))
                sketches.append(_sketch(parts))
                prints.append(fingerprint(hashes(shingles(words, WORDS))))
            made = [pa.array(counts, pa.int32()), pa.array(sketches, pa.binary()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return texts.mapInArrow(apply, schema)


def _sets_of_ends(texts: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(node, parts) of the texts of pairs; texts are shuffled only if their numbers are too many to broadcast."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes(shingles(words_of(t), size))).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "parts"])

    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    if ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ends = F.broadcast(ends)
    return texts.select("node", "text").join(ends, "node", "left_semi").mapInArrow(apply, "node long, parts array<long>")


def verified_pairs(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs whose sets of shingles are alike: first by their sketches, then, for those left, by their whole sets."""
    hubs = hubs_of(pairs)
    left = saved(_within_sketches(pairs, texts.select("node", "n", "sketch"), similarity, hubs), "pairs")
    parts = saved(_sets_of_ends(texts, left, size), "parts")
    both = joined_end(joined_end(left, "a", parts.withColumnRenamed("parts", "pa"), hubs), "b", parts.withColumnRenamed("parts", "pb"), hubs)
    common = F.size(F.array_intersect("pa", "pb"))
    out = saved(both.where(common >= similarity * (F.size("pa") + F.size("pb") - common)).select("a", "b"), "alike")
    dropped(parts, left, *([hubs] if hubs is not None else []))
    return out


def print_ties(texts: DataFrame, radius: int = RADIUS, most: int = MEMBERS) -> DataFrame:
    """(a, b), a > b, of texts (node, n, fp) that SimHash links: as many pairs as connect all texts within `radius` bits.

    The first text of a fingerprint stands for it: the others are tied to it, and it to those of the linked fingerprints.
    Texts without words are left out, as they share no shingle.
    """
    own = texts.where("n > 0").select(F.col("node").alias("a"), F.col("fp").alias("b"))
    prints = saved(own.groupBy("b").agg(F.min("a").alias("first")).withColumnRenamed("b", "fp"), "fingerprints")
    first = lambda name: prints.select(F.col("fp").alias("node"), F.col("first").alias(name))
    own = joined_end(own, "b", first("y"), hubs_of(own)).select(F.col("a").alias("x"), "y")
    links = print_links(prints, "fp", radius, most)
    hubs = hubs_of(links)
    across = joined_end(joined_end(links, "a", first("x"), hubs), "b", first("y"), hubs).select("x", "y")
    return own.unionAll(across).where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def near_duplicate_groups(docs: DataFrame, similarity: float = 0.8, size: int = 5, tile: int = TILE) -> DataFrame:
    """(digest, doc_id, root_digest, root_id) of every distinct text that isn't the one to stay of its group.

    Texts group if they are equal, or linked by pairs whose sets of `size`-word shingles have a Jaccard similarity of at
    least `similarity`. SimHash comes first: texts whose fingerprints it links (`print_ties`) are verified on whole texts and
    become components. An exact search does the rest, as fingerprints miss links: all such pairs meet on a shingle of their
    prefixes (`shared_prefixes`). In up to ROUNDS rounds the components of each key are tied to its first text (`key_ties`),
    so a large group of copies becomes one component with as many pairs as it has members; then all candidates between
    different components are verified, so none is left out.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    named = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    texts = named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("text").alias("text"))
    # Numbered as they are written, so no two texts have one number.
    numbered = texts.select("digest", "least", "text", F.monotonically_increasing_id().alias("node"))
    texts = saved(with_prints(numbered, size), "texts")
    rooted = links = tested = None

    def tied(pairs: DataFrame, what: str) -> bool:
        """Verifies the pairs that have not been tested; true if they gave new links."""
        nonlocal rooted, links, tested
        new = saved(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), what)
        if new.isEmpty():
            return False
        found = verified_pairs(new, texts, similarity, size)
        tested, links = (new, found) if tested is None else (tested.unionAll(new), links.unionAll(found))
        if found.isEmpty():
            return False
        rooted = components(links)
        return True

    def members() -> DataFrame:
        if rooted is None:
            return met.withColumn("root", F.col("node"))
        return met.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))

    tied(print_ties(texts), "prints")
    met = saved(shared_keys(shared_prefixes(texts, similarity, size)), "met")
    for _ in range(ROUNDS):
        if not tied(key_ties(members(), similarity), "ties"):
            break
    tied(across_pairs(members(), similarity, tile), "candidates")
    dropped(met)
    whole = texts.select("digest", "least", "node")
    whole = whole.withColumn("root", F.col("node")) if rooted is None else whole.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = whole.groupBy("root").agg(F.min(F.struct("least", "digest")).alias("stay"))
    out = saved(whole.join(stays, "root").select("digest", F.col("stay.digest").alias("root_digest"), F.col("stay.least").alias("root_id")), "groups")
    dropped(texts, *[t for t in (tested, links, rooted) if t is not None])
    return out


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest doc_id, once."""
    groups = near_duplicate_groups(docs, **options)
    stay = groups.where("digest = root_digest").select(F.col("digest").alias("__digest"), F.col("root_id").alias("__id"))
    named = docs.select("*", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("__digest"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("__id"))
    once = W.partitionBy("__id", "__digest").orderBy("__digest")
    left = named.join(stay, ["__id", "__digest"], "left_semi")
    return left.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(docs.columns)


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = saved(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "prints")
    return linked(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
