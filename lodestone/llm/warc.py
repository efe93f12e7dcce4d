"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader cuts files into byte ranges; a task
looks for the gzip magic in its range, takes a candidate for a record only if it decodes
to a whole WARC header, and owns the records that start inside its range, wherever they
end. So one large archive is read by many tasks without an index.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir, small_batches

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1"
#: Payloads below this are never revisits.
LEAST_BYTES = 100
ROTATE_BYTES, RANGE_BYTES, BLOCK = 256 << 20, 32 << 20, 256 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:lodestone:page:"
#: Most tasks of a reading stage; beyond, a task reads several ranges.
TASKS = 20_000
RECORD = "file string, offset long, length long, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary, valid boolean"


def store(uri: str):
    """The file system of a path and the path within it, for any scheme pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:", "", uri))


def _named(value) -> str:
    return f"<{_URN}{'' if value is None else value}>"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if is_revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_named(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_line(url)}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: {_named(refers_to)}", f"WARC-Profile: {PROFILE}"] if is_revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Write a record for each row and return the manifest (``file``, ``bytes``, ``records``).

    A null html is an empty payload. Of equal payloads of at least ``LEAST_BYTES`` bytes the
    one with the smallest id is the response and the others revisit it. Ids that are null
    are never referred to: where all are null, all are responses; rows that repeat the
    smallest id are responses too. Columns of other names are left out. The archive's files
    are those of the manifest: what a lost task leaves behind isn't in it. No rows give no
    files; a page has to fit a task.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = path or f"{shared_dir(spark)}/lodestone-warc-{uuid.uuid4().hex}"
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # only payloads that occur again are joined; a hot one is split by adaptive execution
    first = rows.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    typed = rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", "first")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(path)
        files.create_dir(base, recursive=True)
        task, made, out, n = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], None, 0
        for b in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"part-{task}-{len(made):04d}.warc.gz"
                    out, n = files.open_output_stream(f"{base}/{name}", compression=None), 0
                out.write(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first, first is not None and page_id != first, date))
                n += 1
                if out.tell() >= ROTATE_BYTES:
                    made.append((f"{path}/{name}", out.tell(), n))
                    out.close()
                    out = None
        if out is not None:
            made.append((f"{path}/{name}", out.tell(), n))
            out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "bytes", "records"), m, strict=True)) for m in made], pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    typed.mapInArrow(written, "file string, bytes long, records long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``bytes`` of the archives under a path (a glob too), from anywhere Spark can list."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


class Moving:
    """The bytes of an open file from an offset on, read once from front to end; what lies behind is dropped."""

    def __init__(self, source, size: int, at: int):
        self.source, self.size, self.base, self.held = source, size, at, bytearray()
        source.seek(at)

    def more(self) -> bool:
        raw = self.source.read(min(BLOCK, self.size - self.base - len(self.held)))
        self.held += raw
        return bool(raw)

    def find(self, what: bytes, at: int) -> int:
        """The first place of ``what`` from an offset on, in what is held; -1 if it isn't there."""
        found = self.held.find(what, at - self.base)
        return found if found < 0 else found + self.base

    def drop(self, at: int) -> None:
        del self.held[: at - self.base]
        self.base = at

    def piece(self, at: int, n: int) -> bytes:
        """Some of the bytes at an offset, at most ``n``; none at the file's end."""
        if at - self.base >= len(self.held):
            self.more()
        return bytes(self.held[at - self.base : at - self.base + n])


def _member(moving: Moving, at: int) -> tuple[bytes, int] | None:
    """The decoded member at an offset and the offset after it; None if there is no record."""
    d, out, checked, n = zlib.decompressobj(31), bytearray(), False, 4096
    while not d.eof:
        raw = moving.piece(at, n)
        if not raw:
            return None
        at, n = at + len(raw), min(2 * n, 1 << 16)
        try:
            out += d.decompress(raw)
        except zlib.error:
            return None
        if not checked and len(out) >= len(VERSION):
            if not out.startswith(b"WARC/"):
                return None
            checked = True
    return (bytes(out), at - len(d.unused_data)) if checked and b"\r\n\r\n" in out else None


def parsed(raw: bytes) -> dict | None:
    """The fields of a decoded record; None if its header isn't whole."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not sep or not length.isdigit() or len(rest) < int(length):
        return None
    block = rest[: int(length)]
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
    kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "revisit":
        n = fields.get("x-payload-length", "")
        return {"kind": kind, "fields": fields, "n": int(n) if n.isdigit() else None, "digest": said, "payload": None, "valid": said is not None}
    own = hashlib.sha256(payload).hexdigest()
    return {"kind": kind, "fields": fields, "n": len(payload), "digest": own, "payload": payload, "valid": said is None or said == own}


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """The records that start inside [start, end) of an open file, with their offsets.

    The file is read once, from ``start`` to where the last of these records ends, and at most a
    block beyond; a candidate that is no record is looked through again in memory.
    """
    moving, at = Moving(source, size, start), start
    while at < end:
        found = moving.find(MAGIC, at)
        if found < 0:
            # a magic may lie across two blocks
            at = max(at, moving.base + len(moving.held) - len(MAGIC) + 1)
            moving.drop(at)
            if at >= end or not moving.more():
                return
            continue
        if found >= end:
            return
        member = _member(moving, found)
        record = member and parsed(member[0])
        if record:
            yield found, record | {"length": member[1] - found}
        at = member[1] if record else found + 1
        moving.drop(at)


def read(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives (``file`` and ``bytes`` rows), by byte ranges dealt over tasks.

    Response payloads are checked against their digest (``valid``). ``payloads=False`` leaves
    them out after the check. Files without records and empty files give no rows; bytes that
    are no record are passed over (:func:`skipped` counts them). A record has to fit a task.
    """
    small_batches(spark)
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    # a number of its own: ranges are short rows of much work, which adaptive execution would put into one task
    tasks = files.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / range_bytes))).first()[0]
    ranges = ranges.repartition(int(min(max(1, tasks or 0), TASKS)), "file", "start")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in RECORD.split(", ")])
        rows, held = [], 0
        for b in batches:
            for file, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                files, name = store(file)
                with files.open_input_file(name) as source:
                    for offset, r in records_in(source, size, start, min(size, start + range_bytes)):
                        f = r["fields"]
                        body = r["payload"] if payloads else None
                        rows.append((file, offset, r["length"], r["kind"], f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), r["n"], r["digest"], body, r["valid"]))
                        held += len(body or b"")
                        if len(rows) >= 1024 or held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=names)

    return ranges.mapInArrow(scanned, RECORD)


def skipped(files: DataFrame, records: DataFrame) -> DataFrame:
    """``file``, ``bytes`` and ``skipped``: the bytes of each file that lie in no record that was read."""
    read_ = records.groupBy("file").agg(F.sum("length").alias("__n"))
    return files.join(read_, "file", "left").select("file", "bytes", (F.col("bytes") - F.coalesce("__n", F.lit(0))).alias("skipped"))


def page_id(urn: str):
    """The page id in a record id that :func:`write` gave, as a column; null if there is none."""
    return F.expr(f"try_cast(regexp_extract({urn}, '^<{_URN}(-?[0-9]+)>$', 1) as bigint)")
