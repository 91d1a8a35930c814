"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing. Every row becomes one record, gzipped as a member of its own: a response with an
HTTP message around the payload, or, where a row with an equal payload and a larger id
exists, a revisit of it without payload. Archives roll at ``roll_bytes``; a task writes to
hidden names and moves whole files to names that depend on the task's number only, so a
task that is run again replaces its own files.

Reading. Members (or plain records) are taken one after another while they check out: the
gzip checksum, the version line, the header block, the length, the record's end, and the
block and payload digests. After a failed check the reader looks for the next gzip magic
whose member begins with a version line, or the next version line itself, goes on there,
and logs the bytes in between as a quarantined gap with its reason. Records whole inside a
broken member are kept.

Size: duplicates join by digest; only digests that occur more than once are on the small
side, so Spark broadcasts it when it is small and splits hot digests otherwise.

Defined cases: null payload is empty; with ``least_bytes`` 0 empty payloads revisit each
other too; null ids never win a group: a group of null ids only is all responses; repeated
rows with the winning id are all responses; nulls in other columns are left out of the
record; an empty table gives an empty archive set.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 16 << 20
MAGIC = b"\x1f\x8b\x08"


def digest(data: bytes) -> str:
    """Bare base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    return " ".join(str(value).split())


def record(kind: str, payload: bytes, *, page_id=None, uri=None, refers_to=None, date="1970-01-01T00:00:00Z") -> bytes:
    """One uncompressed record with its closing lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    own = digest(payload)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {own}')}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to} {own}')}>", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{own}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member of its own, without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def plan_records(pages: DataFrame, *, id: str = "page_id", payload: str = "html", uri: str = "url", least_bytes: int = 0) -> DataFrame:
    """(page_id, uri, payload, kind, refers_to): payload is null for revisits of others."""
    rows = pages.select(F.col(f"`{id}`").cast("long").alias("page_id"), (F.col(f"`{uri}`") if uri else F.lit(None)).cast("string").alias("uri"), F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8").alias("payload"))
    key = F.concat_ws(":", F.sha1("payload"), F.length("payload"))
    many = rows.filter(F.length("payload") >= least_bytes).select("page_id", key.alias("key")).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").select("key", "last")
    many = C.write_table(many)
    joined = rows.withColumn("key", key).join(many, "key", "left")
    revisit = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return joined.select("page_id", "uri", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(planned: DataFrame, directory: str, *, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the records; a table (file, records, bytes) of what was written."""

    def run(batches):
        filesystem, root = C.hadoop_filesystem(directory)
        filesystem.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        count = size = records = 0
        stream = hidden = None

        def close():
            name = f"part-{part:06d}-{count:05d}.warc.gz"
            stream.close()
            filesystem.move(hidden, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

        for b in batches:
            for i, uri, payload, kind, refers_to in zip(*(b.column(k) for k in range(5))):
                if stream is None:
                    hidden = f"{root}/_{part:06d}-{count:05d}-{attempt}.warc.gz"
                    stream = filesystem.open_output_stream(hidden, compression=None)
                data = member(record(kind.as_py(), payload.as_py(), page_id=i.as_py(), uri=uri.as_py(), refers_to=refers_to.as_py()))
                stream.write(data)
                size, records = size + len(data), records + 1
                if size >= roll_bytes:
                    yield close()
                    stream, count, size, records = None, count + 1, 0, 0
        if stream is not None:
            yield close()

    return C.write_table(planned.select("page_id", "uri", "payload", "kind", "refers_to").mapInArrow(run, "file string, records long, bytes long"))


# ---- reading -----------------------------------------------------------------------------


class Damaged(Exception):
    pass


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The member at ``at`` and where it ends; Damaged carries what came out before."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            piece = data[pos : pos + (1 << 16)]
            if not piece:
                raise Damaged("truncated member", b"".join(out))
            out.append(z.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Damaged(f"bad member: {str(e)[:60]}", b"".join(out)) from None
    return b"".join(out), pos - len(z.unused_data)


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The plain record at ``at`` and where it ends, all checks done."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/1.", at) or end < 0:
        raise Damaged("no version line or header block")
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    head = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if not colon:
            raise Damaged("bad header line")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
        raise Damaged("no length or type")
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = data[start:stop]
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        raise Damaged("block digest differs")
    payload, length = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if head["warc-type"] == "revisit":
            for x in top.split(b"\r\n")[1:]:
                if x.lower().startswith(b"content-length:"):
                    length = int(x.split(b":")[1])
    want = head.get("warc-payload-digest", "")
    if head["warc-type"] == "revisit":
        own = want.removeprefix("sha1:")
    else:
        own = digest(payload)
        if want.startswith("sha1:") and want[5:] != own:
            raise Damaged("payload digest differs")
    return {"head": head, "payload": payload, "payload_bytes": length, "payload_digest": own}, stop + 4


def _next_start(data: bytes, at: int) -> int:
    """The next place where a version line or a member with one begins, or the end."""
    while True:
        a, b = data.find(MAGIC, at), data.find(b"WARC/1.", at)
        found = min(x for x in (a, b, len(data)) if x >= 0)
        if found == len(data) or found == b:
            return found
        try:
            if zlib.decompressobj(31).decompress(data[found : found + 4096], 7).startswith(b"WARC/1."):
                return found
        except zlib.error:
            pass
        at = found + 1


def salvage(data: bytes, nested: bool = False):
    """("record", offset, length, record) and ("gap", offset, length, reason), in order."""
    at, n = 0, len(data)
    while at < n:
        try:
            if data.startswith(MAGIC, at):
                inner, end = _inflate(data, at)
                whole = list(salvage(inner, True))
                for kind, _, _, what in whole:
                    yield kind, at, end - at, what
            else:
                found, end = parse_record(data, at)
                yield "record", at, end - at, found
            at = end
        except Damaged as e:
            stop = _next_start(data, at + 1)
            for kind, _, _, what in salvage(e.args[1], True) if len(e.args) > 1 else ():
                if kind == "record":
                    yield kind, at, stop - at, what
            yield "gap", at, stop - at, e.args[0]
            at = stop


READ_SCHEMA = "file string, kind string, offset long, length long, reason string, record_type string, record_id string, uri string, page_id long, refers_to long, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, directory: str, *, with_payload: bool = False) -> DataFrame:
    """Records and gaps of every archive in ``directory``; ``kind`` tells which is which."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path", "content")
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")] + ["payload"] * with_payload

    def number(x):
        return int(x) if x and x.lstrip("-").isdigit() else None

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows, held = [], 0
                for kind, offset, length, what in salvage(content.as_py()):
                    row = [path.as_py(), kind, offset, length]
                    if kind == "gap":
                        row += [what] + [None] * 7 + [None] * with_payload
                    else:
                        h = what["head"]
                        row += [None, h["warc-type"], h.get("warc-record-id"), h.get("warc-target-uri"), number(h.get("x-page")), number(h.get("x-refers-to-page")), what["payload_bytes"], what["payload_digest"]]
                        row += [what["payload"]] * with_payload
                        held += len(what["payload"]) * with_payload
                    rows.append(row)
                    if len(rows) >= 10_000 or held > 16 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(run, READ_SCHEMA + (", payload binary" if with_payload else ""))


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows, names):
    kinds = dict(x.split() for x in READ_SCHEMA.split(", ")) | {"payload": "binary"}
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kinds[n]]) for c, n in zip(zip(*rows), names)], names=names)


def round_trip(pages: DataFrame, *, id: str = "page_id", payload: str = "html", uri: str = "url", least_bytes: int = 0) -> DataFrame:
    """Writes every row into archives in the shared folder and returns what they hold."""
    spark = pages.sparkSession
    directory = C.shared_dir(spark)
    planned = plan_records(pages, id=id, payload=payload, uri=uri, least_bytes=least_bytes)
    filesystem, root = C.hadoop_filesystem(directory)
    filesystem.create_dir(root, recursive=True)
    write_archives(planned, directory)
    return read_archives(spark, directory)
