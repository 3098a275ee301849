"""Each query's operator against a plain brute-force version, on awkward rows and on the smallest table."""

import hashlib
import math
import re

import pytest
import regex
import xxhash
from cases import DOCS, both, frame, same

from cohortloom.llm import bpe, decontaminate, licenses, pii, quality, repeats, secrets, simhash, warc


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def docs_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_op1(spark):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    for df in both(spark):
        want = []
        for d, x in docs_of(df):
            ids = t.encode(x, add_special_tokens=False).ids
            want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
        same(bpe.token_digests(df, path), want)
    ids = bpe.encode(frame(spark), path)
    assert bpe.decode(ids, path).count() == ids.count()


def brute_repeats(docs, n=50):
    first = {}
    for d, x in docs:
        b = x.encode()
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            k = math.inf if d is None else d
            first[s] = min(first.get(s, math.inf), k)
    for d, x in docs:
        b = x.encode()
        cover = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < (math.inf if d is None else d):
                cover[i : i + n] = b"\1" * n
        kept = bytes(c for c, gone in zip(b, cover) if not gone)
        yield d, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), sha(kept)


@pytest.mark.parametrize("chunk", [1500, 40_000, repeats.CHUNK])
def test_op2(spark, chunk):
    from pyspark.sql import functions as F

    for df in both(spark):
        got = repeats.without_repeats(df, chunk).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        same(got, brute_repeats(docs_of(df)))


def test_cover_is_a_difference_cover():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def brute_simhash(docs, radius=3):
    fps = []
    for d, x in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", x.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(p, 42) for p in s]
        fps.append(sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h)))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(docs, fps))]


def test_op3(spark):
    for df in both(spark):
        same(simhash.simhash_components(df), brute_simhash(docs_of(df)))


def test_dense_cluster_of_fingerprints(spark):
    """Thousands of fingerprints around two centres, with chains between them: the components are those of all pairs."""
    import random

    import numpy as np

    r = random.Random(3)
    prints = [0]
    for _ in range(2600):
        prints.append(r.choice(prints[-60:]) ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 5]))))
    f = np.unique(np.array(prints, dtype=np.uint64))
    root = np.arange(len(f))
    for i in range(len(f)):
        near = np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 3)
        roots = {int(root[j]) for j in near} | {i}
        root[np.isin(root, list(roots))] = min(roots)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(f.view(np.int64))], "doc_id long, fp long")
    same(simhash.linked(df).select("doc_id", "component_id"), [(i, int(k)) for i, k in enumerate(root)])


def test_large_keys_are_dealt_in_blocks(spark):
    """No task's key has more members than two blocks, and the components are those of all pairs."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(4)
    given = sorted({r.choice([7, 7 << 20]) | v << 32 for v in r.sample(range(1 << 12), 1500)})
    prints = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "doc_id long, fp long")
    keys = simhash.ball_keys(prints.select("fp", F.col("fp").alias("__node"), F.col("fp").alias("__check")), "fp", "__node", "__check")
    most = lambda k: k.groupBy("__key").count().agg(F.max("count")).first()[0]
    assert most(keys) > 700 and most(simhash.dealt_keys(keys, simhash.large_keys(prints, "fp", 66))) <= 3 * 66
    root = list(range(len(given)))
    for i in range(len(given)):
        for k in {root[j] for j in range(i) if (given[i] ^ given[j]).bit_count() <= 3}:
            low, high = sorted((k, root[i]))
            root = [low if x == high else x for x in root]
    same(simhash.linked(prints, most=66).select("doc_id", "component_id"), list(enumerate(root)))


def test_op5(spark):
    phrase = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for df in both(spark):
        got = {}
        for r in licenses.license_scan(df).collect():
            got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        want = {}
        for d, x in docs_of(df):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
            at = [(i, k) for k, p in phrase.items() for i in range(len(w)) if w[i : i + len(p)] == p]
            want.setdefault(d, []).append((len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({k for _, k in at}))))
        assert {d: sorted(v, key=str) for d, v in got.items()} == {d: sorted(v, key=str) for d, v in want.items()}
    full = {r["doc_id"]: r for r in licenses.license_scan(frame(spark)).collect()}
    assert full[100 + 3 * 22]["labels"] == "mit" and full[100 + 3 * 22]["score"] > 0.9


def luhn(d):
    s = [int(c) for c in d[::-1]]
    return (sum(s[::2]) + sum(sum(divmod(2 * c, 10)) for c in s[1::2])) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute_pii(x):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, x) if ok(m[0])]
    return [(n, s, e) for s, _, e, n in sorted(found)]


def test_op6(spark):
    for df in both(spark):
        want = []
        for d, x in docs_of(df):
            s = brute_pii(x)
            want.append((d, *[sum(k == n for k, _, _ in s) for n in pii.BASE_KINDS], sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))))
        same(pii.pii_digests(df).drop("spans"), want)
    added = {r["doc_id"]: r["spans"] for r in pii.pii_digests(frame(spark)).collect()}[100 + 3 * 24]
    assert {s.split(":")[0] for s in added.split(",")} == {"email", "card", "iban", "ssn", "account", "url"}
    text = pii.personal_spans(frame(spark), redacted="text").where("doc_id = 172").first()["text"]
    assert "DE89" not in text and "<IBAN>" in text


def test_op7(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "one two three"), (3, None), (None, "a b c d e f g h"), (4, ""), (5, "rep rep rep rep rep rep rep"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    filler = " ".join(f"w{i}" for i in range(3000))
    given = [
        (1, f"{filler} Alpha, beta gamma; delta epsilon zeta eta theta iota KAPPA {filler}"), (2, "alpha beta gamma delta epsilon"), (3, None), (4, ""),
        (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, "rep " * 5), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappaX"), (6, "one two three"),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in given], DOCS)
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    same(got.select("doc_id", "item_id", "n_shingles", "n_found"), [(1, 1, 6, 6), (5, 5, 1, 1), (6, 1, 6, 5)])
    assert not decontaminate.contaminated(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count()


def test_op7_finds_planted_items_of_all_sizes(spark):
    import random

    r = random.Random(1)
    word = lambda: f"v{r.randrange(100_000)}"
    items = [(i, [word() for _ in range(r.choice([5, 6, 9, 20, 60, 300]))]) for i in range(120)]
    docs, want = [], set()
    for d in range(300):
        body = [word() for _ in range(400)]
        if d % 2:
            i, words = r.choice(items)
            words = list(words)
            if len(words) >= 60:
                words[len(words) // 2] = "swapped"
            body[200:200] = words
            want.add((d, i))
        docs.append((d, " ".join(body), "en", "s", 0))
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want


def brute_warc(pages):
    d = [(p, (h or "").encode()) for p, h in pages]
    least = {}
    for p, b in d:
        if len(b) >= 100 and p is not None:
            least[b] = min(p, least.get(b, p))
    return [(p, len(b), sha(b), "response" if least.get(b, p) == p else "revisit", None if least.get(b, p) == p else least[b]) for p, b in d]


def test_op8(spark):
    big = "<p>é</p>" * 40_000
    pages = [(3, "http://a/\r\nX: 1", "x" * 100), (1, "http://b", "x" * 100), (2, None, "x" * 99), (9, "u", "x" * 99), (4, "é", None), (5, "u", ""), (7, "u", big), (8, "u", big), (None, "u", big), (1, "http://b", "x" * 100), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, offset string").repartition(4)
    same(warc.archive_round_trip(df), brute_warc([(p, h) for p, _, h in pages]))
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    same(warc.archive_round_trip(df), brute_warc([(r["page_id"], r["html"]) for r in df.collect()]))
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def brute_secrets(x):
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in regex.finditer(p, x, regex.A) if ok(m)]
    return [(n, s, e) for s, _, e, n in sorted(found)]


def test_op9(spark):
    for df in both(spark):
        want = []
        for d, x in docs_of(df):
            s = brute_secrets(x)
            want.append((d, *[sum(k == n for k, _, _ in s) for n in ("assign", "access", "hex")], sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))))
        same(secrets.secret_digests(df).drop("spans"), want)


def test_op9_entropy(spark):
    from pyspark.sql import functions as F

    values = ["aZ3kQ9xT7bLm2PqR8sVw4YcN1dF6", "a" * 40, "abababababababababababab", "short", "0123456789" * 3]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.largest_entropy(F.col("v")).alias("e")).collect()
    for r in got:
        w = secrets.WINDOW
        each = [-sum(c / w * math.log2(c / w) for c in (p.count(x) for x in set(p))) for p in (r["v"][i : i + w] for i in range(len(r["v"]) - w + 1))]
        assert abs(r["e"] - max(each, default=0)) < 1e-9, r
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(frame(spark)).collect()}[100 + 3 * 26]
    assert spans.split(",")[0] == "entropy:0:28" and "entropy:" in spans.split(",")[-1] and len(spans.split(",")) == 2


def brute_quality(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    count = {}
    for i in range(len(w) - 2):
        count[tuple(w[i : i + 3])] = count.get(tuple(w[i : i + 3]), 0) + 1
    rep = set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            rep |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def test_op10(spark):
    for df in both(spark):
        got = quality.quality_report(df)
        same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), [(d, *brute_quality(x)) for d, x in docs_of(df)])
        assert got.where("base_failed and kept").count() == 0


def test_op10_bands(spark):
    import base64
    import random

    r = random.Random(2)
    noise = " ".join(base64.b64encode(r.randbytes(60)).decode() for _ in range(400))
    again = "\n".join(f"{i} buy cheap pills now and win the casino jackpot today {i * 7 % 10}" for i in range(900))
    got = {x["doc_id"]: x["reason"] for x in quality.quality_report(frame(spark, [(1, noise, "", "", 0), (2, again, "", "", 0)])).collect()}
    assert got == {1: "incompressible", 2: "repetitive"} or got == {1: "incompressible", 2: "base"}


def noise_and_prose(size, r):
    """Line-broken base64 and hexadecimal noise (over 50 words where it fits), and a clean text of the table, of `size` bytes."""
    import base64

    import pyarrow.parquet as pq

    words = lambda s, n: "\n".join(s[i : i + n] for i in range(0, len(s), n))[:size]
    n = min(64, max(16, size // 60))
    clean = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist() if t and not brute_quality(t)[5] and quality.Rules().measure(t)[6]]
    whole = " ".join(sorted(clean, key=lambda t: hashlib.md5(t.encode()).digest()))
    at = r.randrange(len(whole) // 2)
    return words(base64.b64encode(r.randbytes(size)).decode(), n), words(r.randbytes(size).hex(), n), whole[at : at + size]


@pytest.mark.parametrize("size", [1000, 1500, 2500, 4000, 5000, 8000, 12_000, 40_000, 90_000])
def test_op10_noise_of_all_lengths(size):
    import random

    base64, hexes, prose = noise_and_prose(size, random.Random(size))
    for text in (base64, hexes):
        got = quality.Rules().measure(text)
        assert got[6] is False and got[10] in ("incompressible", "base"), (size, got)
        assert len(text.split()) < 50 or got[10] == "incompressible"
    assert quality.Rules().measure(prose)[6], quality.Rules().measure(prose)


def test_op10_noise_in_chunks():
    import random

    base64, hexes, prose = noise_and_prose(24_576, random.Random(3))
    for noise in (base64, hexes):
        got = quality.Rules().measure(prose[:12_288] + noise[:20_480])
        assert got[10] in ("chunks", "incompressible") and got[8] == 5, got


def test_op10_judges_the_last_chunk():
    """Every byte is in a chunk, and chunks count by their bytes."""
    import random

    noise, hexes, prose = noise_and_prose(8_000, random.Random(9))
    rules = quality.Rules()
    for junk in (noise, hexes):
        got = rules.measure(prose[:4_096] + junk[:7_900])  # one of the two whole chunks, but most bytes
        assert got[6] is False and (got[8], got[9]) == (2, 3), got
        got = rules.measure(prose[:4_096] + junk[:3_900])  # junk in the second half alone
        assert (got[8], got[9]) == (1, 2), got
        got = rules.measure(junk[:4_096] + prose[:3_900])  # the same amount of junk in the first half
        assert (got[8], got[9]) == (1, 2), got
        got = rules.measure(junk[:4_096] + prose[:8_000] + "\n")
        assert got[10] is None and (got[8], got[9]) == (1, 3), got
    assert rules.measure(prose[:4_097])[9] == 2 and rules.measure(prose[:3_000])[9] == 1 and rules.measure("")[9] == 0
