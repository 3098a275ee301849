"""Periodic runs against a plain scan of every place and period, dealt ranges of lags, and long texts."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from cases import DOCS, both, frame, same
from test_contracts import docs_of, sha

from cohortloom.llm import periods


def brute_runs(w, min_exp=4, min_length=6):
    n, found = len(w), []
    for q in range(1, n // min_exp + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if len(x) >= max(min_length, min_exp * q) and not any(x[p:] == x[:-p] for p in range(1, q)):
                found.append((i, len(x), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_rows(docs):
    for d, x in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", x.encode())
        n = len(w)
        if d is not None and n and zlib.crc32(str(d).encode()) % 10 == 0:
            g = zlib.crc32(str(d).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        yield (d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
               sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(b" ".join(v for i, v in enumerate(w) if i not in drop)))


def test_op12(spark):
    for df in both(spark):
        short = [(d, x) for d, x in docs_of(df) if len(x) < 20_000]
        got = periods.period_digests(df.where("coalesce(length(text), 0) < 20000"))
        same(got, brute_rows(short))
    assert any(r["n_runs"] for r in got.collect())


def words_of(r, n, letters):
    w = [r.choice(letters) for _ in range(n)]
    for _ in range(r.randrange(4)):
        a, p, k = r.randrange(n), r.randrange(1, 2 + n // 5), r.choice([2, 3, 4, 5, 9])
        w[a : a + p * k + r.randrange(p)] = (w[a : a + p] * (k + 1))[: p * k + r.randrange(p)]
    return w


@pytest.mark.parametrize(("min_exp", "min_length"), [(4, 6), (2, 2), (3, 10)])
def test_scan_against_brute_force(min_exp, min_length):
    r = random.Random(min_exp)
    for _ in range(400):
        w = words_of(r, r.randrange(1, 160), r.choice(["a", "ab", "abcd", "abcdefghijklmnop"]))
        ids = periods.word_numbers([c.encode() for c in w])
        found = periods.Scan(ids, min_exp, min_length).lags(1, len(w) + 1)
        assert sorted(found, key=lambda x: (x[0], x[2])) == brute_runs(w, min_exp, min_length), w
        dealt = [x for low, high in periods.lag_ranges(len(w), min_exp, 7) for x in periods.Scan(ids, min_exp, min_length).lags(low, high)]
        assert sorted(dealt) == sorted(found)


def test_dealt_texts_are_like_whole_ones(spark):
    r = random.Random(2)
    rows = [(k % 4, " ".join(words_of(r, 150, "abcd")), None, None, k) for k in range(40)] + [(1, None, None, None, 99), (2, "", None, None, 98)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    whole = periods.periodic_runs(df).select("n_chars", "runs", "collapsed", "n_words")
    dealt = periods.periodic_runs(df, long_bytes=20, range_words=16).select("n_chars", "runs", "collapsed", "n_words")
    same(dealt, [tuple(x) for x in whole.collect()])
    assert {(x["n_chars"], len(x["runs"]), x["collapsed"]) for x in whole.where("n_chars > 97").collect()} == {(99, 0, ""), (98, 0, "")}


def test_clashing_names(spark):
    df = frame(spark).selectExpr("doc_id", "text", "1 as runs", "2 as start", "3 as period", "4 as n_words")
    out = periods.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "start", "period", "n_words", "runs", "collapsed"] and out.count() == df.count()
    with pytest.raises(ValueError, match="twice"):
        periods.periodic_runs(df, min_exp=1)


@pytest.mark.parametrize("name", ["one word", "two words", "cycle", "random", "lines", "fibonacci"])
def test_a_quarter_million_words(name):
    n, r = 250_000, random.Random(6)
    fib = ["a", "ab"]
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    ids = {
        "one word": np.zeros(n, np.int32), "two words": np.arange(n, dtype=np.int32) % 2, "cycle": np.arange(n, dtype=np.int32) % 997, "random": np.array(r.choices(range(50), k=n), np.int32),
        "lines": np.array([x for k in range(n // 50) for x in ([k + 100] * 10 + [1, 2, 3, 4] * 10)], np.int32), "fibonacci": np.frombuffer(fib[-1][:n].encode(), np.uint8).astype(np.int32),
    }[name]
    start = time.perf_counter()
    found = periods.Scan(ids).lags(1, len(ids) + 1)
    assert time.perf_counter() - start < 60
    want = {"one word": [(0, n, 1)], "two words": [(0, n, 2)], "cycle": [(0, n, 997)], "fibonacci": []}.get(name)
    assert found == want if want is not None else len(found) >= (10_000 if name == "lines" else 0)
