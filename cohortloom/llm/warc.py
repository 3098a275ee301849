"""WARC archives: write, normalise, read back.

`write_archives` streams each partition of captures into archives that are one gzip stream each, as careless tools
write them. `normalise` inflates such a stream once, from start to end, rewrites every record as a gzip member of its
own and writes a sidecar index (one JSON line a record: offset, length, id, type) next to the archive. `read_records`
then fetches members by offset. Nothing holds more than one record and one block of the stream at a time.

Files are written under names that carry the task attempt, and only names that a finished attempt reported go on: a
lost executor leaves a stray file, never a half record. Paths may be of any file system that pyarrow opens.

Of captures with one payload of at least `REVISIT_LEAST` bytes, that with the smallest id is the response and the
others are revisits, which carry digest and size but no payload. Defined results: a null payload is empty; rows with
the smallest id repeated are all responses; a null id is a response unless an equal payload has an id, and is never
referred to; a null url is an empty target; no captures give no archive and no rows. Only page_id, url and html are read,
so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import saved, shared_dir

REVISIT_LEAST = 100
ROLL = 256 << 20
BLOCK = 1 << 20
LEVEL = 1
BROADCAST_ROWS = 1_000_000

_END = b"\r\n"


def _target(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it; Spark's names of one store (s3a, s3n) are the same store's."""
    scheme, mark, rest = path.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path)


def _clean(value: str) -> str:
    """A header value: control characters would break the header apart and are escaped."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _urn(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: response with its payload after an HTTP head, or revisit without."""
    revisit = refers_to is not None
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(page, digest),
        "WARC-Date": date,
        "WARC-Target-URI": _clean(url or ""),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if page is not None:
        head["X-Page-Id"] = str(page)
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to, digest), "X-Refers-To-Page": str(refers_to), "X-Payload-Length": str(len(payload))}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8") + _END + block + _END + _END


def parse_head(data: bytes) -> dict[str, str]:
    """Fields by name in lower case; bytes that are no UTF-8 become replacement marks, lines without a colon are passed over."""
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, colon, value in (line.partition(":") for line in lines[1:]) if colon}


def with_revisits(pages: DataFrame, page: str = "page_id", payload: str = "html") -> DataFrame:
    """Adds payload_digest and refers_to. Only ids and digests are shuffled unless the revisits are too many to broadcast."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.withColumn("payload_digest", F.sha2(body, 256))
    sized = rows.where((F.octet_length(body) >= REVISIT_LEAST)).select(F.col(page).alias("__p"), F.col("payload_digest").alias("__d"))
    first = sized.groupBy("__d").agg(F.min("__p").alias("refers_to"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and refers_to is not null").select("__d", "refers_to")
    first = saved(first, "revisits")
    small = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(first) if small else first, (rows["payload_digest"] == first["__d"]) & ~F.col(page).eqNullSafe(F.col("refers_to")), "left")
    return out.drop("__d")


def write_archives(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html, payload_digest, refers_to) as whole-file gzip streams; (archive, records) of what was written."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = _target(path)
        fs.create_dir(root, recursive=True)
        out = packer = None
        number = records = size = 0
        name, done = "", []

        def close() -> None:
            out.write(packer.flush())
            out.close()
            done.append((name, records))

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")]):
                if out is None or size >= ROLL:
                    if out is not None:
                        close()
                    name = f"part-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.gz"
                    out, packer = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    number, records, size = number + 1, 0, 0
                data = record_bytes(row[0], row[1], (row[2] or "").encode("utf-8"), row[3], row[4], date)
                out.write(packer.compress(data))
                records, size = records + 1, size + len(data)
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{n}" for n, _ in done]), pa.array([r for _, r in done], pa.int64())], names=["archive", "records"])

    columns = captures.select("page_id", "url", "html", "payload_digest", "refers_to")
    return saved(columns.mapInArrow(apply, "archive string, records long"), "archives")


def inflated(stream) -> Iterator[bytes]:
    """Blocks of a gzip stream of one or more members, inflated once; a stream that ends inside a member is an error."""
    unpack, inside = zlib.decompressobj(31), False
    while data := stream.read(BLOCK):
        while data:
            inside = True
            if block := unpack.decompress(data, BLOCK * 4):
                yield block
            if unpack.eof:
                data = unpack.unused_data
                unpack, inside = zlib.decompressobj(31), False
            else:
                data = unpack.unconsumed_tail
    if inside:
        raise ValueError("the archive ends inside a gzip member")


def records_of(blocks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, whole record) in order; a record cut off at the end of the stream is an error."""
    held = bytearray()

    def more() -> bool:
        block = next(blocks, None)
        if block is not None:
            held.extend(block)
        return block is not None

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record's head")
                return
        head = bytes(held[:at])
        whole = at + 4 + int(parse_head(head)["content-length"]) + 4
        while len(held) < whole:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(held[:whole])
        del held[:whole]


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Rewrite each archive with one gzip member a record, and beside it a sidecar index; (archive, sidecar, records) of each."""
    count = archives.count()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                fs, at = _target(source)
                to, root = _target(path)
                to.create_dir(root, recursive=True)
                name = f"{source.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{attempt}.norm.warc.gz"
                offset = records = 0
                with fs.open_input_stream(at, compression=None) as stream, to.open_output_stream(f"{root}/{name}", compression=None) as out, to.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    for head, record in records_of(inflated(stream)):
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        out.write(member)
                        fields = parse_head(head)
                        index.write(json.dumps({"offset": offset, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type")}).encode() + b"\n")
                        offset, records = offset + len(member), records + 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([f"{path}/{name}.idx"]), pa.array([records], pa.int64())], names=["archive", "sidecar", "records"])

    dealt = archives.select("archive").repartition(max(1, count))
    return saved(dealt.mapInArrow(apply, "archive string, sidecar string, records long"), "normalised")


def sidecar_index(normalised: DataFrame) -> DataFrame:
    """(archive, offset, length) of every member, read from the sidecars; one that lists another number of records is an error."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, sidecar, records in zip(*[batch.column(c).to_pylist() for c in ("archive", "sidecar", "records")]):
                fs, at = _target(sidecar)
                seen, rows = 0, []
                with fs.open_input_stream(at, compression=None) as stream:
                    for line in _lines(stream):
                        entry = json.loads(line)
                        rows.append((archive, entry["offset"], entry["length"]))
                        if len(rows) >= 5000:
                            yield _index_batch(rows)
                            seen, rows = seen + len(rows), []
                if rows:
                    yield _index_batch(rows)
                if seen + len(rows) != records:
                    raise ValueError(f"{sidecar} lists {seen + len(rows)} records of {records}")

    return normalised.select("archive", "sidecar", "records").mapInArrow(apply, "archive string, offset long, length long")


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while data := stream.read(BLOCK):
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


def _index_batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    names, offsets, lengths = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["archive", "offset", "length"])


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every member the index lists.

    A response's size and digest are taken from its payload as read; a SHA-256 digest that differs from the head's is an
    error. Archives of others may lack what `record_bytes` adds: page, reference and a revisit's size are null then.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if archive != name:
                    if opened is not None:
                        opened.close()
                    fs, at = _target(archive)
                    opened, name = fs.open_input_file(at), archive
                opened.seek(offset)
                record = zlib.decompress(opened.read(length), 31)
                cut = record.index(b"\r\n\r\n")
                head = parse_head(record[:cut])
                kind, said = head.get("warc-type"), head.get("warc-payload-digest", "")
                digest = said.removeprefix("sha256:") if said.startswith("sha256:") else None
                payload, size = None, head.get("x-payload-length")
                if kind == "response":
                    block = record[cut + 4 : -4]
                    payload = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else block
                    size, own = len(payload), hashlib.sha256(payload).hexdigest()
                    if digest not in (None, own):
                        raise ValueError(f"payload of {head.get('warc-record-id')} differs from its digest")
                    digest = own
                own, other = head.get("x-page-id"), head.get("x-refers-to-page")
                rows.append((own and int(own), head.get("warc-target-uri"), kind, other and int(other), size and int(size), digest, payload))
                if len(rows) >= 500:
                    yield _record_batch(rows)
                    rows = []
            if rows:
                yield _record_batch(rows)

    return index.select("archive", "offset", "length").mapInArrow(apply, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, normalise the archives and read every record back."""
    root = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    written = write_archives(with_revisits(pages.select("page_id", "url", "html")), f"{root}/whole")
    index = sidecar_index(normalise(written, f"{root}/members"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= {REVISIT_LEAST} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
