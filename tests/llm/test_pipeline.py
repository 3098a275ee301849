"""The pipeline's stages against brute force, on the smallest table and on awkward rows."""

import hashlib
import re

from cases import DOCS, frame, sample
from test_contracts import brute_pii

import corpus_pipeline
from cohortloom.llm import pii, quality, simhash


def shingle_set(text, n=5):
    w = (text or "").encode().translate(simhash._LOWER).split()
    return set(simhash.shingles(w, n))


def brute_groups(rows, least=0.8):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingle_set(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def test_near_duplicate_stage(spark):
    df = sample(spark)
    rows = sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    groups = brute_groups(rows)
    want = {rows[g][0] for g in set(groups)}
    got = [r["doc_id"] for r in simhash.without_near_duplicates(df).select("doc_id").collect()]
    assert len(got) == len(set(got))
    assert want == set(got)


def test_near_duplicates_of_awkward_rows(spark):
    df = frame(spark)
    out = simhash.without_near_duplicates(df)
    assert out.columns == df.columns
    texts = [r["text"] for r in out.collect()]
    assert len(texts) == len({t or "" for t in texts})
    assert simhash.without_near_duplicates(df.limit(0)).count() == 0


def test_many_near_copies_leave_one(spark):
    import random

    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = [(10_000 - i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :]), "en", "s", 0) for i, k in enumerate(r.choices(range(400), k=700))]
    rows += [(50_000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(300)), "en", "s", 0) for i in range(50)]
    got = sorted(x["doc_id"] for x in simhash.without_near_duplicates(spark.createDataFrame(rows, DOCS)).select("doc_id").collect())
    assert got == [10_000 - 699, *range(50_000, 50_050)]


def planted_edits():
    """Texts and copies of them with new words in one passage: added at the end, cut, a swapped paragraph; at about 0.80 to 0.90."""
    import random

    r = random.Random(21)
    some = lambda n: [f"z{r.randrange(10**7)}" for _ in range(n)]
    rows = []
    for k in range(120):
        base = some(r.choice([60, 200, 500]))
        n = len(base)
        far = round(n * r.uniform(0.10, 0.19))
        swap = round(far / 2)
        at = r.randrange(5, n - swap - 5)
        copy = [base + some(far), base[: n - far], base[:at] + some(swap) + base[at + swap :]][k % 3]
        rows += [(2 * k, " ".join(base), "en", "s", 0), (2 * k + 1, " ".join(copy), "en", "s", 0)]
    return rows


def test_contiguous_edits_are_found_without_loss(spark):
    rows = planted_edits()
    groups = brute_groups([(d, t) for d, t, *_ in rows])
    want = sorted({rows[g][0] for g in groups})
    assert len(want) < 150
    got = sorted(r["doc_id"] for r in simhash.without_near_duplicates(spark.createDataFrame(rows, DOCS)).select("doc_id").collect())
    assert got == want
    df = sample(spark)
    rows = sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    got = sorted(r["doc_id"] for r in simhash.without_near_duplicates(df).select("doc_id").collect())
    assert got == sorted({rows[g][0] for g in brute_groups(rows)})


def test_ties_and_sketches_lose_no_link(spark):
    """Families whose members are near 0.8 of each other, through all rounds, against brute force; tiles of a few members."""
    import random

    r = random.Random(31)
    rows = []
    for f in range(6):
        base = [f"f{f}w{r.randrange(10**6)}" for _ in range(r.choice([60, 150]))]
        for _ in range(40):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**7)}"
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    want = sorted({rows[g][0] for g in brute_groups([(d, t) for d, t, *_ in rows])})
    for tile in (8, 512):
        got = sorted(x["doc_id"] for x in simhash.without_near_duplicates(spark.createDataFrame(rows, DOCS), tile=tile).select("doc_id").collect())
        assert got == want and 6 < len(want) < len(rows)


def test_keys_of_one_text_alone_go(spark, monkeypatch):
    """Over batches of two rows each, so that keys go on from batch to batch; common keys pass and are dealt by text."""
    rows = [(k, n, 10, 0, c) for k, ns, c in [(1, [1], False), (2, [1, 2], False), (3, [5], True), (4, range(7), False), (5, [1], False), (6, [1, 2, 3], True)] for n in ns]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    got = sorted((r["key"], r["node"]) for r in simhash.shared_keys(spark.createDataFrame(rows, "key long, node long, n int, at int, common boolean")).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((k, n) for k, n, *_ in rows if k not in (1, 5))


def test_blocks_of_a_key_meet_in_all_pairs(spark):
    """A template family below 0.8 shares its keys: all pairs of different roots come out, from blocks of a few members each."""
    members = spark.createDataFrame([(1, i, 100, 0, i % 7) for i in range(60)] + [(2, i, 100, 0, 5) for i in range(9)], "key long, node long, n int, at int, root long")
    for tile in (4, 512):
        got = {(r["a"], r["b"]) for r in simhash.across_pairs(members, 0.8, tile).collect()}
        assert got == {(a, b) for a in range(60) for b in range(a) if a % 7 != b % 7}


def test_whole_pipeline(spark):
    """All stages together against brute force: rules, groups over all pairs, containment over all items, spans, library tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    rows = sorted((r["doc_id"], r["text"]) for r in sample(spark).collect())
    rules, anchors = quality.Rules(), pii.Anchors()
    rows = [(d, t) for d, t in rows if rules.measure(t)[6]]
    rows = [rows[g] for g in sorted(set(brute_groups(rows)))]
    sh = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 4)}
    items = [x for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect() if (x := sh(r["text"]))]
    rows = [(d, t) for d, t in rows if not any(len(i & sh(t)) >= 0.8 * len(i) for i in items)]
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens.no_truncation()
    tokens.no_padding()
    want = {}
    for d, t in rows:
        text = pii.redact(t, x) if (x := anchors.spans(t)) else t
        want[d] = (text, tokens.encode(text, add_special_tokens=False).ids)
    assert {r["doc_id"]: (r["text"], r["ids"]) for r in out} == want and len(out) == len(want) > 50
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "tokens"]


def test_pii_stage_redacts(spark):
    df = frame(spark)
    out = corpus_pipeline.pii_stage(spark, df, "")
    assert out.columns == df.columns and out.count() == df.count()
    for r in out.where("text is not null").collect():
        assert not [s for s in brute_pii(r["text"]) if s[0] in ("email", "card")], r["text"]


def test_decontamination_stage(spark):
    """Rows go by their text: a null id that holds an item goes, a clean row that shares an id with one that does stays."""
    items = {r["item_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    clean = "clean text of its own " * 3
    docs = [(1, clean, "", "", 0), (2, f"before {items[0]} after", "", "", 0), (None, items[1], "", "", 0), (2, clean + "too", "", "", 0), (None, None, None, None, None), (1, clean, "", "", 0)]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(docs, DOCS), "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == sorted([(1, clean), (1, clean), (2, clean + "too"), (None, None)], key=str)


def test_stage_columns(spark):
    df = frame(spark)
    assert corpus_pipeline.quality_stage(spark, df, "").columns == df.columns
    r = corpus_pipeline.token_stage(spark, spark.createDataFrame([(1, None, None, None, None)], DOCS), "").first()
    assert r["n_tokens"] == 0 and r["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_a_hub_is_dealt_to_many_tasks(spark):
    """A family of 20,000 copies tied to one text: the join gives every pair once, and no task's key has more than a few blocks."""
    from pyspark.sql import functions as F

    pairs = spark.range(1, 20_001).selectExpr("id as a", "0L as b").unionAll(spark.range(30_000, 30_100).selectExpr("id as a", "id - 1 as b"))
    side = spark.range(40_000).selectExpr("id as node", "id * 2 as v")
    hubs = simhash.hubs_of(pairs)
    assert [tuple(r) for r in hubs.collect()] == [(0, 5)] and simhash.hubs_of(pairs.where("b > 0")) is None
    got = simhash.joined_end(pairs, "b", side, hubs)
    assert got.count() == 20_100 and got.where("v <> 2 * b").count() == 0 and got.distinct().count() == 20_100
    salt = F.pmod(F.xxhash64("a", "b"), F.lit(5))
    assert pairs.where("b = 0").groupBy(salt).count().agg(F.max("count")).first()[0] < 1.1 * simhash.HUB


def test_hubs_change_nothing(spark, monkeypatch):
    df = frame(spark)
    rows = lambda d: sorted(map(str, d.collect()))
    plain = rows(simhash.without_near_duplicates(sample(spark).unionByName(df)))
    found = simhash.hubs_of
    monkeypatch.setattr(simhash, "hubs_of", lambda pairs: found(pairs, 1))
    assert rows(simhash.without_near_duplicates(sample(spark).unionByName(df))) == plain


def test_near_duplicates_go_through_simhash(spark, monkeypatch):
    """The stage's first pairs are SimHash's: they connect just the texts that brute force over fingerprints does."""
    import random

    made, ties = [], simhash.print_ties
    monkeypatch.setattr(simhash, "print_ties", lambda texts, **more: made.append((texts, ties(texts, **more))) or made[-1][1])
    dropped = simhash.dropped
    monkeypatch.setattr(simhash, "dropped", lambda *tables: None)
    r = random.Random(5)
    words = [[f"w{r.randrange(10**6)}" for _ in range(400)] for _ in range(12)]
    rows = [" ".join(w[:k] + ["new"] * (k > 0) + w[k + 1 :]) for w in words for k in (0, 9, 200, 390)] + [" ".join(w).upper() for w in words] + [" ", "\n", ""]
    df = sample(spark).unionByName(spark.createDataFrame([(10**6 + i, t, "en", "s", 0) for i, t in enumerate(rows)], DOCS))
    stayed = corpus_pipeline.near_duplicate_stage(spark, df, "").count()
    monkeypatch.setattr(simhash, "dropped", dropped)
    [(texts, pairs)] = made
    rows = sorted((r["node"], r["text"]) for r in texts.where("n > 0").collect())
    prints = [simhash.fingerprint(simhash.hashes(simhash.shingles(simhash.words_of(t), 3))) for _, t in rows]
    assert {r["node"]: r["fp"] % 2**64 for r in texts.where("n > 0").collect()} == {n: p for (n, _), p in zip(rows, prints)}

    def parts(edges):
        root = {n: n for n, _ in rows}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {n: find(n) for n in root}

    want = parts((rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS)
    assert parts((r["a"], r["b"]) for r in pairs.collect()) == want and len(set(want.values())) < len(rows) - 12
    assert 0 < stayed < df.count()


def test_workers_keep_no_words(spark):
    """Spark keeps Python workers for other stages: none of them holds the words that a task of the token stage has encoded."""
    import pyarrow as pa

    from cohortloom.llm import bpe

    docs = spark.range(4000).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "concat_ws(' ', transform(sequence(0, 20), k -> sha2(string(id * 21 + k), 256))) as text").repartition(4)
    assert corpus_pipeline.token_stage(spark, docs, "").where("n_tokens > 100").count() == 4000

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(m.known) for m in bpe._made.values())])], names=["n"])

    assert {r["n"] for r in spark.range(64).repartition(64).mapInArrow(held, "n long").collect()} == {0}


def test_sketches_and_fingerprints_are_one_map(spark):
    """Maps in a row have a Python worker each; a task that makes a text's shingles, sketch and fingerprint has one."""
    from pyspark.sql import functions as F

    texts = sample(spark).unionByName(frame(spark)).select("text").distinct().withColumn("node", F.monotonically_increasing_id())
    made = simhash.with_prints(texts, 5)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = made.collect()
    assert [r["fp"] % 2**64 for r in rows] == [simhash.fingerprint(simhash.hashes(simhash.shingles(simhash.words_of(r["text"]), 3))) for r in rows]
    assert [r["n"] for r in rows] == [len(set(simhash.shingles(simhash.words_of(r["text"]), 5))) for r in rows]
