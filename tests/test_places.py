"""Records with line breaks over many splits, FASTA by place, and runs that are stopped."""

import csv
import io
import random
import threading
import time

import pytest

from cohortloom.operators import scoring
from cohortloom.sources import files


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    small_splits(spark, "700")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


CELLS = ["plain", "", "two\nlines", 'a "quoted" word', 'ends with "', '"', '""', "x,y", "\n", "\n\n", 'a\n"b"\n,c', "5 inches", "é😀", ",", '",\n"']


def test_quoted_line_breaks_over_splits(splits, tmp_path):
    r = random.Random(3)
    rows = [[f"case-{i}", "synthetic", f"f-{i}", "symptom", r.choice(CELLS) or "n", r.choice(CELLS), r.choice(CELLS)] for i in range(400)]
    names = ["case_id", "data_class", "finding_id", "kind", "name", "value", "assay"]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(names)
    for i, row in enumerate(rows):
        writer.writerow(row)
        if i % 50 == 0:
            out.write("\n")
    path = tmp_path / "findings.csv"
    path.write_text(out.getvalue())
    lines = files.numbered(splits.read.option("lineSep", "\n").text(str(path)), file="path")
    assert lines.rdd.getNumPartitions() > 5
    got = files.findings(splits, str(path))
    found = {x["record"]: (x["case_id"], x["name"], x["value"] or "", x["assay"] or "", x["malformed"]) for x in got.collect()}
    assert found == {i + 2: (row[0], row[4], row[5], row[6], False) for i, row in enumerate(rows)}
    for block in (1, 7, 64):
        texts = {x["record"]: x["text"] for x in files.csv_records(lines, block).collect()}
        assert list(csv.reader(io.StringIO("\n".join(texts[k] for k in sorted(texts)))))[1:] == rows and sorted(texts) == list(range(1, 402))


def test_quotes_inside_plain_cells(spark):
    lines = ['a,b', '5" pipe,x', '"in ""it""', 'still in', 'out",5" y', '"closed"odd,"open', 'x"', '', 'last,"']
    df = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(lines)], "path string, record long, value string")
    got = {x["record"]: x["text"] for x in files.csv_records(df, 2).collect()}
    assert got == {1: "a,b", 2: '5" pipe,x', 3: '"in ""it""\nstill in\nout",5" y', 4: '"closed"odd,"open\nx"', 5: 'last,"'}
    assert files.csv_records(df.limit(0)).count() == 0


def fasta(tmp_path, contigs, width=60):
    text, index, at = "", [], 0
    for name, s in contigs.items():
        text += f">{name} note\n"
        index.append((name, len(s), len(text), width, width + 1))
        text += "".join(s[i : i + width] + "\n" for i in range(0, len(s), width))
    (tmp_path / "g.fa").write_text(text)
    return str(tmp_path / "g.fa"), index


def test_bases_by_place(spark, tmp_path):
    r = random.Random(1)
    contigs = {k: "".join(r.choices("acgtN", k=n)) for k, n in (("c1", 5000), ("c2", 1), ("c3", 60), ("c4", 200_000))}
    path, want = fasta(tmp_path, contigs)
    index = files.index_of(spark, path)
    assert sorted((x["chromosome"], x["length"], x["offset"], x["line_bases"], x["line_bytes"]) for x in index.collect() if x["chromosome"] != "c2") == sorted(w if w[1] >= 60 else None for w in want if w[0] != "c2")
    asked = [(c, p) for c, s in contigs.items() for p in {0, 1, 2, len(s) - 1, len(s), *r.choices(range(2, max(3, len(s))), k=40)}] + [("zz", 5)] * 3
    got = files.indexed_contexts(spark.createDataFrame(asked, "chromosome string, position long"), index, 512).collect()
    assert len(got) == len(set(asked))
    for x in got:
        s, p = contigs.get(x["chromosome"], ""), x["position"]
        inside = 2 <= p < len(s)
        assert x["context"] == (s[p - 2 : p + 1].upper() if inside else None), x
        assert x["problem"] == ("not in the index" if not s else None if inside else "lacks complete context")
    chunks = files.fasta_chunks(spark, path, 1024).collect()
    for x in got[:50]:
        if x["context"]:
            c = next(c for c in chunks if (c["chromosome"], c["chunk"]) == (x["chromosome"], (x["position"] - 1) // 1024))
            at = x["position"] - c["chunk"] * 1024
            assert c["sequence"][at - 1 : at + 2] == x["context"]


def test_only_the_windows_asked_for_are_read(tmp_path):
    path, _ = fasta(tmp_path, {"c": "ACGT" * 250_000})
    w = files.Windows(4096)
    for place in (10, 11, 4000, 500_000, 500_001):
        assert len(w.bytes_at(path, [place, place + 1, place + 2])) == 3
    assert w.read <= 2 * 4096 and w.bytes_at(path, [5_000_000, 5_000_001, 5_000_002]) is None


def test_odd_widths_are_refused(spark, tmp_path):
    (tmp_path / "odd.fa").write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(Exception, match="differ in width"):
        files.index_of(spark, str(tmp_path / "odd.fa")).collect()


def asked(spark, n):
    return scoring.requests(spark.createDataFrame([("synthetic", i) for i in range(n)], "data_class string, x long"), ["x"])


def scorer(wait=False):
    """Defined in here, so that workers, which lack this module, get it by value."""

    def lengths(s):
        import time

        time.sleep(120 if wait else 0)
        return s.str.len().astype(str)

    return lengths


lengths = scorer()


def test_budgets_and_resume_keep_answers(spark, tmp_path):
    df, memo, tried = asked(spark, 9), str(tmp_path / "memo"), str(tmp_path / "tried")
    assert scoring.run(df, lengths, scoring.Budget(2, 10_000), memo, tried, batch=1).count() == 2
    stop = threading.Event()
    stop.set()
    with pytest.raises(scoring.Stopped, match="cancelled"):
        scoring.run(df, lengths, scoring.Budget(9, 10_000), memo, tried, stop=stop)
    with pytest.raises(scoring.Stopped, match="timeout"):
        scoring.run(df, lengths, scoring.Budget(9, 10_000, 0.0), memo, tried)
    assert spark.read.parquet(tried).count() == 2
    assert scoring.run(df, lengths, scoring.Budget(9, 10_000, 600), memo, tried, batch=4).count() == 9
    assert spark.read.parquet(tried).count() == 9


@pytest.mark.parametrize("how", ["stop", "deadline"])
def test_a_batch_under_way_is_stopped(spark, tmp_path, how):
    df, memo, tried = asked(spark, 12), str(tmp_path / "memo"), str(tmp_path / "tried")
    scoring.run(df.where("x < 3"), lengths, scoring.Budget(9, 10_000), memo, tried, batch=2)
    stop = threading.Event()
    if how == "stop":
        threading.Timer(8, stop.set).start()
    start = time.monotonic()
    with pytest.raises(scoring.Stopped, match="cancelled" if how == "stop" else "timeout"):
        scoring.run(df.where("x >= 10"), scorer(True), scoring.Budget(9, 10_000, None if how == "stop" else 8), memo, tried, stop=stop)
    assert time.monotonic() - start < 60
    assert scoring._stored(spark, memo, "request_sha256 string, response string").count() == 3
    # What was under way is uncertain: not sent again, unless it is asked for.
    assert scoring.run(df, lengths, scoring.Budget(20, 10_000), memo, tried).count() == 10
    assert scoring.run(df, lengths, scoring.Budget(20, 10_000), memo, tried, resend_uncertain=True).count() == 12
    assert spark.range(5).count() == 5
