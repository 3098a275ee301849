"""Archives that other tools wrote, cut streams and the sidecar index."""

import gzip
import json
import os

import pytest

from cohortloom.llm import warc

FOREIGN = (
    b"WARC/1.0\r\nwarc-type: warcinfo\r\nwarc-record-id: <urn:x:0>\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    b"WARC/1.0\r\nWARC-TYPE:response\r\nWARC-Target-URI: http://caf\xe9/\r\nWARC-Payload-Digest: sha1:ABC\r\nCONTENT-LENGTH: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nyes\r\n\r\n"[:-4].replace(b"21", b"22")
    + b"\r\n\r\n"
)


def read(spark, folder, data):
    path = f"{folder}/foreign.warc.gz"
    with open(path, "wb") as f:
        f.write(data)
    archives = spark.createDataFrame([(path, 2)], "archive string, records long")
    made = warc.normalise(archives, f"{folder}/members")
    return made, warc.read_records(warc.sidecar_index(made))


def test_foreign_archive(spark, tmp_path):
    made, records = read(spark, str(tmp_path), gzip.compress(FOREIGN))
    got = {r["record_type"]: r for r in records.collect()}
    assert set(got) == {"warcinfo", "response"}
    r = got["response"]
    assert bytes(r["payload"]) == b"yes" and r["payload_bytes"] == 3 and r["page_id"] is None and r["url"].startswith("http://caf")
    row = made.first()
    with open(row["sidecar"], encoding="utf-8") as f:
        entries = [json.loads(x) for x in f]
    with open(row["archive"], "rb") as f:
        whole = f.read()
    assert [gzip.decompress(whole[e["offset"] : e["offset"] + e["length"]])[:8] for e in entries] == [b"WARC/1.0"] * 2 and entries[-1]["offset"] + entries[-1]["length"] == len(whole)


@pytest.mark.parametrize("data", [gzip.compress(FOREIGN)[:-9], gzip.compress(FOREIGN[:-30]), gzip.compress(FOREIGN + b"WARC/1.0\r\nWARC-Type"), gzip.compress(FOREIGN[:95])[:-8] + b""])
def test_cut_archives_are_errors(data):
    import io

    with pytest.raises((ValueError, StopIteration)):
        list(warc.records_of(warc.inflated(io.BytesIO(data))))


def test_sidecar_that_lists_fewer_records_is_an_error(spark, tmp_path):
    made, _ = read(spark, str(tmp_path), gzip.compress(FOREIGN))
    sidecar = made.first()["sidecar"]
    with open(sidecar, encoding="utf-8") as f:
        lines = f.readlines()
    os.unlink(sidecar)
    with open(sidecar, "w", encoding="utf-8") as f:
        f.writelines(lines[:1])
    with pytest.raises(Exception, match="lists 1 records of 2"):
        warc.sidecar_index(made).count()


def test_names_of_one_store():
    assert warc.parse_head(b"WARC/1.1\r\nA: b:c\r\nnone\r\nX-Y:z") == {"a": "b:c", "x-y": "z"}
    for name in ("s3a://bucket/key", "s3n://bucket/key"):
        try:
            assert warc._target(name)[1] == "bucket/key"
        except Exception as e:  # a build without the store's client names the store, not the scheme
            assert "s3a" not in str(e) and "s3n" not in str(e)
