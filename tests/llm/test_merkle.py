"""The manifest against a tree made level by level on the driver: ragged partitions, several rounds, other fanouts, ties and nulls."""

import hashlib
import zlib

import pytest
from cases import DOCS, frame, same, sample

from cohortloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves, b):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + b]) for i in range(0, len(found[-1]), b)])
    return found


def proof_of(levels, i, b):
    found = []
    for level in levels[:-1]:
        low = i // b * b
        found += [x for k, x in enumerate(level[low : low + b], low) if k != i]
        i //= b
    return found


def fold_of(leaf, levels, i, b):
    for level in levels[:-1]:
        low = i // b * b
        leaf = h(*[leaf if k == i else x for k, x in enumerate(level[low : low + b], low)])
        i //= b
    return leaf


def leaf_of(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute(rows, b=2):
    trees = {}
    for d, text, lang, source, n in rows:
        off = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        trees.setdefault(lang, []).append((d is not None, d or 0, leaf_of(d, source, lang, n, text), leaf_of(d, source, lang, n + 1 if off else n, text), d))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {x: levels_of([r[2] for r in sorted(trees[x])], b) for x in langs}
    top = levels_of([made[x][-1][0] for x in langs], b)
    root = top[-1][0] if langs else None
    for k, x in enumerate(langs):
        for i, (_, _, leaf, other, d) in enumerate(sorted(trees[x])):
            folded = fold_of(fold_of(other, made[x], i, b), top, k, b)
            yield d, leaf, made[x][-1][0], root, h(*proof_of(made[x], i, b), *proof_of(top, k, b)), folded, folded == root


@pytest.mark.parametrize(("fanout", "most", "fan_in"), [(2, merkle.PACKED, merkle.FAN_IN), (2, 3, 2), (3, 5, 3), (4, 1, 5)])
def test_op13(spark, fanout, most, fan_in):
    for df in (frame(spark), sample(spark), spark.createDataFrame([(7, "one", None, None, None)], DOCS)):
        same(merkle.manifest_digests(df, fanout, most, fan_in), brute([tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()], fanout))


def test_nodes_and_repeated_rows(spark):
    rows = [(5, "same", "xx", "s", 4)] * 37 + [(k, str(k), "é" if k % 3 else None, None, k) for k in range(50)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    same(merkle.manifest_digests(df, 2, 4, 3), brute(rows))
    leaves = df.select("doc_id", merkle.tree_key("lang").alias("__tree"), merkle.leaf_digest(["doc_id", "source", "lang", "n_chars", "text"]).alias("__leaf"), df.text.substr(1, 0).alias("__other"))
    made = merkle.manifest(leaves, ["doc_id"], {"doc_id": "long"}, 2, 4, 3)
    want = set()
    tops = []
    for key, lang in (("", None), ("+xx", "xx"), ("+é", "é")):
        levels = levels_of([leaf_of(d, s, g, n, t) for d, t, g, s, n in rows if g == lang], 2)
        tops.append(levels[-1][0])
        want |= {("group", key, k, i, x) for k, level in enumerate(levels) if k for i, x in enumerate(level)}
    want |= {("top", "", k, i, x) for k, level in enumerate(levels_of(tops, 2)) if k for i, x in enumerate(level)}
    got = [tuple(r) for r in made.nodes().collect()]
    assert set(got) == want and len(got) == len(want)


def test_empty_and_clashing(spark):
    df = frame(spark)
    assert merkle.manifest_digests(df.limit(0)).count() == 0
    more = merkle.manifest_digests(df.selectExpr("*", "1 as leaf", "2 as root", "3 as __leaf", "4 as place", "5 as proof"))
    same(more, [tuple(r) for r in merkle.manifest_digests(df).collect()])


def test_numbers_of_nodes():
    for n in range(1, 40):
        for b in (2, 3, 5):
            levels = levels_of([str(i) for i in range(n)], b)
            assert merkle.counts(n, b) == [len(x) for x in levels]
            peaks = merkle.Peaks(b)
            for i in range(n):
                peaks.push(0, i, str(i))
            assert peaks.close()[2] == levels[-1][0]
            for i in range(n):
                assert merkle.fold(str(i), proof_of(levels, i, b), i, n, b) == (levels[-1][0], len(proof_of(levels, i, b)))
