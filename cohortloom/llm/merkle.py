"""A Merkle manifest of a dataset: a tree per group of rows, a tree of their roots, and a proof for every row.

Rows are leaves, sorted by group and order into ranges; each range is packed into partitions of at most `PACKED` leaves
of one group, whose places in the group follow from counts (of ranges first, then within a range). A partition keeps a
stack of peaks: a leaf is pushed, and whenever the last `fanout` nodes are a whole run they become their parent, as a
carry does in a number of that base. What is left is the partition's mountain range: full subtrees, ragged where the
partition starts or ends off a multiple of the base. Ranges of up to `FAN_IN` partitions are merged by the same stack,
round by round, until a group is one range; there the short runs at the end of each level are closed, a run of one
included, without padding. The merged nodes and the peaks are all that a leaf's proof needs from outside its partition, and
they are handed down the same rounds. No task holds more than one partition or `FAN_IN` mountain ranges, however many
rows a group has.

A node's digest is the lowercase hexadecimal SHA-256 of its children's, one after another as text. A leaf's is that of
its fields: a null is `-`, any other value its UTF-8 bytes counted in decimal, a colon and the value.

Defined results: rows of one group and order go by their leaf, so repeated rows have neighbouring places and, if equal,
interchangeable proofs; null ids come first; a null group is a group of its own, before all others; a group of one row
has that leaf as its root, and so has a table of one group with that group's root; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cohortloom.llm.common import saved

FANOUT = 2
PACKED = 1 << 13
FAN_IN = 256
BROADCAST_TREES = 10_000
SALTS = 64

_NODES = "array<struct<level:int,place:long,digest:string>>"
_ARROW_NODES = pa.list_(pa.struct([pa.field("level", pa.int32()), pa.field("place", pa.int64()), pa.field("digest", pa.string())]))
_ARROW_TYPES = {"long": pa.int64(), "string": pa.string()}

Node = tuple[int, int, str]


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Peaks:
    """A mountain range: nodes side by side, the last `fanout` merged whenever they are a whole run."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.stack, self.records = fanout, [], []

    def push(self, level: int, place: int, value: str) -> None:
        stack, b = self.stack, self.fanout
        stack.append((level, place, value))
        while place % b == b - 1 and len(stack) >= b and stack[-b][:2] == (level, place - b + 1):
            level, place, value = level + 1, place // b, digest([v for _, _, v in stack[-b:]])
            del stack[-b:]
            stack.append((level, place, value))
            self.records.append((level, place, value))

    def close(self) -> Node:
        """Makes parents of the short runs at the end of each level, up to the root."""
        stack, b = self.stack, self.fanout
        while len(stack) > 1:
            level, place, _ = stack[-1]
            run = [stack.pop()]
            while stack and stack[-1][0] == level and stack[-1][1] // b == place // b:
                run.append(stack.pop())
            parent = (level + 1, place // b, digest([v for _, _, v in reversed(run)]))
            stack.append(parent)
            self.records.append(parent)
        return stack[0]


def counts(n: int, fanout: int) -> list[int]:
    """Nodes of each level of a tree of n leaves, the root's level included."""
    found = [n]
    while found[-1] > 1:
        found.append(-(-found[-1] // fanout))
    return found


def outside(first: int, end: int, n: int, fanout: int) -> list[tuple[int, int]]:
    """Nodes that proofs of the leaves first <= i < end need and that no full subtree of these leaves is."""
    found, size = [], 1
    for level, count in enumerate(counts(n, fanout)[:-1]):
        low, high = first // size // fanout * fanout, min(((end - 1) // size // fanout + 1) * fanout, count)
        own = range(-(-first // size), end // size)
        found += [(level, k) for k in range(low, high if not own else own.start)]
        if own:
            found += [(level, k) for k in range(own.stop, high)]
        size *= fanout
    return found


def path(place: int, n: int, fanout: int) -> Iterator[tuple[int, int, int, int]]:
    """Level by level: level, place of the node on the path, and the bounds of its run."""
    for level, count in enumerate(counts(n, fanout)[:-1]):
        low = place // fanout * fanout
        yield level, place, low, min(low + fanout, count)
        place //= fanout


def fold(leaf: str, siblings: list[str], place: int, n: int, fanout: int = FANOUT) -> tuple[str, int]:
    """The root that a leaf and its siblings give, and how many siblings that took."""
    at = 0
    for _, own, low, high in path(place, n, fanout):
        k, own = high - low - 1, own - low
        leaf = digest([*siblings[at : at + own], leaf, *siblings[at + own : at + k]])
        at += k
    return leaf, at


def leaf_digest(columns: list[str | Column]) -> Column:
    """The digest of a row's fields."""
    fields = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]), 256)


def _lists(values: dict[str, list], kinds: dict[str, str]) -> list[pa.Array]:
    """One row of lists."""
    return [pa.array([values[c]], pa.list_(_ARROW_TYPES[kinds[c]])) for c in kinds]


def packed(leaves: DataFrame, order: list[str], payload: dict[str, str], most: int = PACKED) -> DataFrame:
    """Rows (__tree, and any payload) sorted by tree and order, as partitions of at most `most` neighbours of one tree with their places."""
    tie = leaves.select("*", F.monotonically_increasing_id().alias("__tie"))
    keys = ["__tree", *order, "__tie"]
    ranges = tie.repartitionByRange(*keys).sortWithinPartitions(*keys).select("__tree", *payload)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = None, {c: [] for c in payload}

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([tree], pa.string()), pa.array([len(held["__leaf"])], pa.int64()), *_lists(held, payload)], names=["__tree", "__n", *payload])

        for batch in batches:
            trees = batch.column("__tree").to_pylist()
            columns = {c: batch.column(c).to_pylist() for c in payload}
            for i, own in enumerate(trees):
                if held["__leaf"] and (own != tree or len(held["__leaf"]) >= most):
                    yield row()
                    held = {c: [] for c in payload}
                tree = own
                for c in payload:
                    held[c].append(columns[c][i])
        if held["__leaf"]:
            yield row()

    made = ranges.mapInArrow(pack, "__tree string, __n long, " + ", ".join(f"{c} array<{k}>" for c, k in payload.items()))
    rows = saved(made.withColumn("__at", F.monotonically_increasing_id()), "packed")
    # Places in two levels: ranges of a tree by their totals, then partitions within a range.
    part = F.shiftrightunsigned("__at", 33)
    sizes = rows.select("__tree", "__at", "__n", part.alias("__part"))
    before = W.partitionBy("__tree").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = sizes.groupBy("__tree", "__part").agg(F.sum("__n").alias("__rows"), F.count("*").alias("__many"))
    starts = totals.select("__tree", "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__many").over(before), F.lit(0)).alias("__many"))
    own = W.partitionBy("__tree", "__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    inner = sizes.select("*", F.coalesce(F.sum("__n").over(own), F.lit(0)).alias("__first"), F.count("*").over(own).alias("__ordinal"))
    placed = inner.join(starts, ["__tree", "__part"]).select("__at", (F.col("__first") + F.col("__rows")).alias("__first"), (F.col("__ordinal") + F.col("__many")).alias("__ordinal"))
    return rows.join(placed, "__at")


def _nodes(rows: list[list[Node]]) -> pa.Array:
    return pa.array([[{"level": k, "place": p, "digest": v} for k, p, v in r] for r in rows], _ARROW_NODES)


def _merged(table: pa.Table, fanout: int) -> tuple[list[dict], Peaks]:
    """Members of a range in order, and the stack that their mountain ranges make."""
    members = sorted(table.to_pylist(), key=lambda m: m["__first"])
    peaks = Peaks(fanout)
    for m in members:
        for node in m["__peaks"]:
            peaks.push(node["level"], node["place"], node["digest"])
    return members, peaks


def _near(members: list[dict], known: dict[tuple[int, int], str], n: int, fanout: int) -> list[list[Node]]:
    return [[(*key, known[key]) for key in outside(m["__first"], m["__end"], n, fanout)] for m in members]


def _known(members: list[dict], peaks: Peaks) -> dict[tuple[int, int], str]:
    return {(k, p): v for k, p, v in peaks.records} | {(x["level"], x["place"]): x["digest"] for m in members for x in m["__peaks"]}


@dataclass
class Forest:
    """Trees as tables: packed partitions, the members of each round of merging, what each partition needs from outside, and the roots."""

    partitions: DataFrame
    rounds: list[DataFrame]
    near: DataFrame
    fanout: int
    fan_in: int

    def roots(self) -> DataFrame:
        """__tree, __size and __root, one row a tree."""
        return self.near.where("__ordinal = 0").select("__tree", "__size", "__root")

    def nodes(self) -> DataFrame:
        """Every node above the leaves: __tree, level, place, digest."""
        fanout, last = self.fanout, len(self.rounds) - 1
        schema = "__tree string, __nodes " + _NODES

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    peaks = _stack(row, fanout)
                    yield pa.RecordBatch.from_arrays([pa.array([row["__tree"]], pa.string()), _nodes([peaks.records])], names=["__tree", "__nodes"])

        def merge(closing: bool):
            def apply(table: pa.Table) -> pa.Table:
                members, peaks = _merged(table, fanout)
                if closing:
                    peaks.close()
                return pa.table([pa.array([members[0]["__tree"]], pa.string()), _nodes([peaks.records])], names=["__tree", "__nodes"])

            return apply

        found = self.partitions.select("__tree", "__first", "__leaf").mapInArrow(local, schema)
        for k, members in enumerate(self.rounds):
            found = found.unionByName(members.groupBy("__tree", F.expr(f"__ordinal div {self.fan_in}")).applyInArrow(merge(k == last), schema))
        return found.select("__tree", F.explode("__nodes").alias("node")).select("__tree", "node.*")


def _stack(row: dict, fanout: int) -> Peaks:
    peaks = Peaks(fanout)
    for k, leaf in enumerate(row["__leaf"]):
        peaks.push(0, row["__first"] + k, leaf)
    return peaks


def forest(partitions: DataFrame, fanout: int = FANOUT, fan_in: int = FAN_IN) -> Forest:
    """Trees over packed partitions."""
    members_schema = f"__tree string, __ordinal long, __first long, __end long, __peaks {_NODES}"
    near_schema = f"__tree string, __ordinal long, __size long, __root string, __near {_NODES}"
    names = ["__tree", "__ordinal", "__first", "__end", "__peaks"]

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                peaks = _stack(row, fanout).stack
                yield pa.RecordBatch.from_arrays([pa.array([row["__tree"]], pa.string()), *(pa.array([v], pa.int64()) for v in (row["__ordinal"], row["__first"], row["__first"] + len(row["__leaf"]))), _nodes([peaks])], names=names)

    def merge(table: pa.Table) -> pa.Table:
        members, peaks = _merged(table, fanout)
        ends = (members[0]["__ordinal"] // fan_in, members[0]["__first"], members[-1]["__end"])
        return pa.table([pa.array([members[0]["__tree"]], pa.string()), *(pa.array([v], pa.int64()) for v in ends), _nodes([peaks.stack])], names=names)

    def handed(members: list[dict], size: int, root: str, near: list[list[Node]]) -> pa.Table:
        columns = [pa.array([m["__tree"] for m in members], pa.string()), pa.array([m["__ordinal"] for m in members], pa.int64()), pa.array([size] * len(members), pa.int64()), pa.array([root] * len(members), pa.string()), _nodes(near)]
        return pa.table(columns, names=["__tree", "__ordinal", "__size", "__root", "__near"])

    def close(table: pa.Table) -> pa.Table:
        members, peaks = _merged(table, fanout)
        size, root = members[-1]["__end"], peaks.close()[2]
        return handed(members, size, root, _near(members, _known(members, peaks), size, fanout))

    def descend(table: pa.Table) -> pa.Table:
        members, peaks = _merged(table, fanout)
        size, root = members[0]["__size"], members[0]["__root"]
        known = _known(members, peaks) | {(x["level"], x["place"]): x["digest"] for x in members[0]["__above"]}
        return handed(members, size, root, _near(members, known, size, fanout))

    members = saved(partitions.select("__tree", "__ordinal", "__first", "__leaf").mapInArrow(climb, members_schema), "peaks")
    most = members.agg(F.max("__ordinal").alias("n")).first()["n"] or 0
    rounds, group = [members], F.expr(f"__ordinal div {fan_in}")
    while most >= fan_in:
        rounds.append(saved(rounds[-1].groupBy("__tree", group).applyInArrow(merge, members_schema), "merged"))
        most //= fan_in
    near = saved(rounds[-1].groupBy("__tree").applyInArrow(close, near_schema), "near")
    for members in reversed(rounds[:-1]):
        above = near.select("__tree", F.col("__ordinal").alias("__group"), "__size", "__root", F.col("__near").alias("__above"))
        given = members.withColumn("__group", group).join(above, ["__tree", "__group"])
        near = saved(given.groupBy("__tree", "__group").applyInArrow(descend, near_schema), "near")
    return Forest(partitions, rounds, near, fanout, fan_in)


def tree_key(column: str) -> Column:
    """A key of a group that is never null and sorts as the groups do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("+"), F.col(column).cast("string")), F.lit(""))


@dataclass
class Manifest:
    """The trees of all groups and the tree of their roots."""

    groups: Forest
    top: Forest
    names: DataFrame

    def proofs(self) -> DataFrame:
        """A row per leaf: the payload given to `manifest`, leaf, place and size in its group, subroot, root, proof (digests level by level), folded_root (of `__other`, or of the leaf where that is null)."""
        payload, fanout = self.groups.partitions.schema, self.groups.fanout
        kept = [f for f in payload.fields if isinstance(f.dataType, T.ArrayType) and f.name not in ("__leaf", "__other")]
        upper = self.names
        few = upper.limit(BROADCAST_TREES + 1).count() <= BROADCAST_TREES
        near = self.groups.near
        if few:
            near = near.join(F.broadcast(upper), "__tree")
        else:
            dealt = upper.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            near = near.withColumn("__salt", F.pmod("__ordinal", F.lit(SALTS)).cast("int")).join(dealt, ["__tree", "__salt"]).drop("__salt")
        rows = self.groups.partitions.join(near, ["__tree", "__ordinal"])
        fields = [T.StructField(f.name, f.dataType.elementType) for f in kept]
        fields += [T.StructField(n, k) for n, k in [("leaf", T.StringType()), ("place", T.LongType()), ("size", T.LongType()), ("subroot", T.StringType()), ("root", T.StringType()), ("proof", T.ArrayType(T.StringType())), ("folded_root", T.StringType())]]
        schema, own = T.StructType(fields), [f.name for f in kept]
        names = schema.names

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    row = {c: one.column(c)[0].as_py() for c in ("__first", "__size", "__root", "__near", "__leaf", "__other", "__top", "__trees", "__upper", "__whole")}
                    known = {(x["level"], x["place"]): x["digest"] for x in row["__near"]}
                    for k, leaf in enumerate(row["__leaf"]):
                        known[0, row["__first"] + k] = leaf
                    known |= {(k, p): v for k, p, v in _stack(row, fanout).records}
                    proofs, folded = [], []
                    for k, leaf in enumerate(row["__leaf"]):
                        place = row["__first"] + k
                        proof = [known[level, s] for level, at, low, high in path(place, row["__size"], fanout) for s in range(low, high) if s != at]
                        proof += row["__upper"]
                        value, used = fold(row["__other"][k] or leaf, proof, place, row["__size"], fanout)
                        folded.append(fold(value, proof[used:], row["__top"], row["__trees"], fanout)[0])
                        proofs.append(proof)
                    n = len(row["__leaf"])
                    arrays = [*(one.column(c).flatten() for c in own), one.column("__leaf").flatten(), pa.array(range(row["__first"], row["__first"] + n), pa.int64()), pa.array([row["__size"]] * n, pa.int64()),
                              pa.array([row["__root"]] * n), pa.array([row["__whole"]] * n), pa.array(proofs, pa.list_(pa.string())), pa.array(folded)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

        return rows.mapInArrow(prove, schema)

    def nodes(self) -> DataFrame:
        """Every node above the leaves of every group (scope `group`, its key in __tree) and above the subroots (scope `top`)."""
        return self.groups.nodes().select(F.lit("group").alias("scope"), "*").unionByName(self.top.nodes().select(F.lit("top").alias("scope"), "*"))


def manifest(leaves: DataFrame, order: list[str], payload: dict[str, str], fanout: int = FANOUT, most: int = PACKED, fan_in: int = FAN_IN) -> Manifest:
    """Trees over rows (__tree, __leaf, __other, the columns of `order` and of `payload`, whose types are long or string)."""
    if fanout < 2 or fan_in < 2:
        raise ValueError("runs and ranges have two nodes or more")
    kinds = payload | {"__leaf": "string", "__other": "string"}
    groups = forest(packed(leaves, [*order, "__leaf"], kinds, most), fanout, fan_in)
    roots = groups.roots().select(F.lit("").alias("__tree"), F.col("__tree").alias("__name"), F.col("__root").alias("__leaf"), F.lit(None).cast("string").alias("__other"))
    top = forest(packed(roots, ["__name"], {"__name": "string", "__leaf": "string", "__other": "string"}, most), fanout, fan_in)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = {(x["level"], x["place"]): x["digest"] for x in row["__near"]}
                known |= {(0, row["__first"] + k): leaf for k, leaf in enumerate(row["__leaf"])} | {(k, p): v for k, p, v in _stack(row, fanout).records}
                places = range(row["__first"], row["__first"] + len(row["__leaf"]))
                upper = [[known[level, s] for level, at, low, high in path(p, row["__size"], fanout) for s in range(low, high) if s != at] for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(row["__name"]), pa.array(places, pa.int64()), pa.array([row["__size"]] * len(places), pa.int64()), pa.array(upper, pa.list_(pa.string())), pa.array([row["__root"]] * len(places))],
                                                 names=["__tree", "__top", "__trees", "__upper", "__whole"])

    rows = top.partitions.join(top.near, ["__tree", "__ordinal"])
    names = saved(rows.mapInArrow(prove, "__tree string, __top long, __trees long, __upper array<string>, __whole string"), "names")
    return Manifest(groups, top, names)


def manifest_digests(docs: DataFrame, fanout: int = FANOUT, most: int = PACKED, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: its leaf, its group's root, the root, a digest of its proof, and the root folded from a leaf that is tampered with where 7 divides the CRC-32 of the id."""
    named = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [F.col(c) + 1 if c == "n_chars" else c for c in named]
    leaves = docs.select("doc_id", tree_key("lang").alias("__tree"), leaf_digest(named).alias("__leaf"), F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(tampered)).alias("__other"))
    found = manifest(leaves, ["doc_id"], {"doc_id": "long"}, fanout, most, fan_in).proofs()
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# CRC-32 bit by bit: SQL has no function of that name. 3988292384 is its polynomial, reversed.
_CRC = """
xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: 0::BIGINT)), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)))))
"""


def _sql_leaf(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR)::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


SQL = f"""
WITH RECURSIVE
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce('+' || lang, '') AS tree, {_sql_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_sql_leaf("n_chars + 1")} END AS other FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM docs),
nodes AS (
  SELECT tree, 0 AS level, place, leaf AS h, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2),
low AS MATERIALIZED (SELECT * FROM nodes),
roots AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, h, n FROM roots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, place // 2),
high AS MATERIALIZED (SELECT * FROM tops),
steps AS MATERIALIZED (
  SELECT r, k.level AS step, s.h AS sibling, (l.place >> k.level) % 2 AS side
  FROM leaves l JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) k USING (tree) LEFT JOIN low s ON s.tree = l.tree AND s.level = k.level AND s.place = xor(l.place >> k.level, 1)
  UNION ALL
  SELECT r, 1000 + k.level, s.h, (t.place >> k.level) % 2
  FROM leaves l JOIN roots t USING (tree) CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) k LEFT JOIN high s ON s.level = k.level AND s.place = xor(t.place >> k.level, 1)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY step) AS k FROM steps),
folds AS (
  SELECT r, 0::BIGINT AS k, coalesce(other, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.r, s.k, sha256(CASE WHEN s.side = 1 THEN coalesce(s.sibling, '') || f.h ELSE f.h || coalesce(s.sibling, '') END) FROM folds f JOIN ranked s ON s.r = f.r AND s.k = f.k + 1),
ends AS (SELECT r, arg_max(h, k) AS h FROM folds GROUP BY r),
proofs AS (SELECT r, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS p FROM ranked GROUP BY r)
SELECT doc_id, leaf, t.h AS subroot, w.h AS root, coalesce(p, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = w.h AS verified
FROM leaves l JOIN roots t USING (tree) CROSS JOIN (SELECT h FROM high WHERE n = 1) w JOIN ends e ON e.r = l.r LEFT JOIN proofs p ON p.r = l.r
"""
