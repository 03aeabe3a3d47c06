"""Operator 7: WARC/1.1 archives of page captures, and transaction assembly from them.

Writing: each capture becomes a request, a response (or, for a payload seen elsewhere, a revisit without the payload) and a metadata
record, each its own gzip member. Of captures with equal payloads, the one with the largest page_id is the response and the
others refer to it. Request and metadata name the capture through WARC-Concurrent-To. Files are named after their partition and
appear by rename, so a task that runs again leaves the same whole files.

Reading: records of all archives are grouped by the identifier they concur to and become one nested row per capture; revisits
find their response through WARC-Refers-To. Payload length and digest are recomputed from each response's bytes.

Nulls and ties: null html is an empty payload, a null url an empty target; a null page_id is below every other. Rows equal in
page_id, url and html have equal records and come back as often as they went in; if they hold the largest page_id they are all
responses. Line ends in a url are escaped in headers. A revisit refers to the response with the largest page_id, and of several by the largest url. An empty table makes no archive
and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_SPACE = uuid.UUID("6f0c2f7a-1c55-4b0e-9a53-0d7a4a1b6f01")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, page_id long, payload binary"


def capture_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{digest}|{url}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(fields: list[tuple[str, str]], block: bytes, level: int = 1) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _line(url: str | None) -> str:
    """A URL as a header value: it may not end the header."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def transaction(page_id: int | None, url: str, payload: bytes, refers: str | None, refers_url: str | None, date: str) -> bytes:
    """The three records of a capture. refers: the record whose payload this one repeats."""
    digest, line = payload_digest(payload), _line(url)
    own = capture_id(page_id, url, digest)
    host = line.partition("://")[2].partition("/")[0]
    path = "/" + line.partition("://")[2].partition("/")[2].partition("#")[0]
    common_fields = [("WARC-Date", date), ("WARC-Target-URI", line)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest_field = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers is None:
        main = member([("WARC-Type", "response"), ("WARC-Record-ID", own), *common_fields, *digest_field, ("Content-Type", "application/http;msgtype=response")], http + payload)
    else:
        again = [("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", _line(refers_url)), ("WARC-Profile", _PROFILE)]
        main = member([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common_fields, *digest_field, *again, ("Content-Type", "application/http;msgtype=response")], http)
    other = [*common_fields, ("WARC-Concurrent-To", own)]
    ask = member([("WARC-Type", "request"), ("WARC-Record-ID", own.replace("uuid:", "uuid:1")), *other, ("Content-Type", "application/http;msgtype=request")], f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    note = member([("WARC-Type", "metadata"), ("WARC-Record-ID", own.replace("uuid:", "uuid:2")), *other, ("Content-Type", "application/warc-fields")], (f"page-id: {page_id}\r\n" if page_id is not None else "").encode())
    return ask + main + note


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive, whatever the gzip members' bounds."""
    view, stream = memoryview(data), None
    if data[:2] == b"\x1f\x8b":
        at = 0
        held = b""
        while at < len(view):
            z, parts = zlib.decompressobj(31), [held]
            while not z.eof and at < len(view):
                parts.append(z.decompress(view[at:at + 65536]))
                at = min(at + 65536, len(view))
            if not z.eof:
                raise ValueError("an archive is cut short")
            at -= len(z.unused_data)
            held = b"".join(parts)
            stream = io.BytesIO(held)
            yield from _parse(stream)
            held = held[stream.tell():]
    else:
        yield from _parse(io.BytesIO(data))


def _parse(stream: io.BytesIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Whole records; stops before an unfinished one."""
    while True:
        begin = stream.tell()
        head = stream.getvalue().find(b"\r\n\r\n", begin)
        if head < 0:
            return
        lines = stream.getvalue()[begin:head].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if len(stream.getbuffer()) < head + 4 + size + 4:
            return
        stream.seek(head + 4)
        block = stream.read(size)
        stream.seek(4, 1)
        yield fields, block


def record_row(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    """A record as a row of RECORD."""
    kind = fields["warc-type"]
    row = {"record_id": fields["warc-record-id"], "type": kind, "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "payload_digest": None, "payload_bytes": None, "page_id": None, "payload": None}
    if kind == "metadata":
        got = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
        row["page_id"] = int(got["page-id"]) if "page-id" in got else None
    elif kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        row["payload_digest"], row["payload_bytes"] = fields["warc-payload-digest"].split(":", 1)[1], length
        if kind == "response":
            if len(body) != length or payload_digest(body) != row["payload_digest"]:
                raise ValueError(f"the payload of {row['record_id']} differs from its digest")
            row["payload"] = body if with_payload else None
    return row


#: Rows of a narrow side that may be broadcast, a few hundred bytes each; above it the join is shuffled with SALTS copies.
BROADCAST_ROWS, SALTS = 50_000, 16


def salted_join(rows: DataFrame, few: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join of wide rows with a table unique in ``key``; a key that many rows share is spread by the column ``spread``."""
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), key, "left")
    salt = common.fresh(rows, "salt")
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS))).join(few.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, salt], "left").drop(salt)


def write_archives(pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, file_bytes: int = 8_000_000, date: str = "1970-01-01T00:00:00Z") -> int:
    """Write ``pages`` (page_id, url, html) under ``path``; the number of archives."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, held, size, files = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            for page_id, url, html, keep_id, keep_url in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                payload, url = (html or "").encode(), url or ""
                again = keep_id != page_id and keep_id is not None and len(payload) >= min_revisit_bytes
                refers = capture_id(keep_id, keep_url or "", payload_digest(payload)) if again else None
                held.append(transaction(page_id, url, payload, refers, keep_url if again else None, date))
                size += len(held[-1])
                if size >= file_bytes:
                    common.publish(path, f"part-{part:06d}-{files:06d}.warc.gz", b"".join(held))
                    held, size, files = [], 0, files + 1
        if held:
            common.publish(path, f"part-{part:06d}-{files:06d}.warc.gz", b"".join(held))
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int32())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    keep = rows.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keep = common.materialize(keep.select("digest", "keep"), "warc-keep")
    joined = salted_join(rows, keep, "digest", "url").select("page_id", "url", "html", F.coalesce("keep.page_id", "page_id").alias("keep_id"), F.coalesce("keep.url", "url").alias("keep_url"))
    ordered = joined.sortWithinPartitions("page_id", "url", F.xxhash64("html"))  # a task that runs again writes the same files
    files = common.map_arrow(ordered, write, "files int").agg(F.sum("files")).first()[0] or 0
    common.drop_table(keep)
    return files


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives under ``path``."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string, "long": pa.int64, "binary": pa.binary}
        schema = pa.schema([(name, kinds[kind]()) for name, kind in (f.split() for f in RECORD.split(", "))])
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for fields, block in records(data.as_buffer().to_pybytes()):
                    held.append(record_row(fields, block, with_payload))
                    size += len(block) if with_payload else 200
                    if size > 8_000_000 or len(held) >= 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return common.map_arrow(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content"), read, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, page_id, capture (response or revisit), request, metadata, refers_to (page_id)."""
    inner = [c for c in found.columns if c != "payload"]
    row = F.struct(*inner, "payload")
    of = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), row))
    keyed = found.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    joined = keyed.groupBy(F.col("capture_id").alias("record_id")).agg(
        of("response", "revisit").alias("capture"), of("request").alias("request"), of("metadata").alias("metadata"),
        F.sum(F.col("type").isin("response", "revisit").cast("int")).alias("copies"),
    ).where("capture is not null")
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("page_id", F.col("metadata.page_id")).withColumn("target", F.col("capture.refers_to"))
    narrow = common.materialize(found.where("type in ('revisit', 'metadata')").select("type", "concurrent_to", "refers_to", "page_id"), "warc-notes")
    targets = narrow.where("refers_to is not null").select(F.col("refers_to").alias("target")).distinct()
    notes = narrow.where("type = 'metadata'").select(F.col("concurrent_to").alias("target"), F.col("page_id").alias("refers_to"))
    origin = common.materialize(notes.join(targets, "target", "left_semi").groupBy("target").agg(F.max("refers_to").alias("refers_to")), "warc-origin")
    common.drop_table(narrow)
    return salted_join(each, origin, "target", "record_id").select("record_id", "page_id", "capture", "request", "metadata", "refers_to")
