"""WARC archives: one gzip member per record, read back by a sequential reader.

The writer decides response or revisit in Spark (by digest groups, aggregated on the map side), then each task writes its
own archives to the shared folder and returns their names; only archives of tasks that succeeded are in that manifest, so a
retried task leaves no double records. The reader inflates in small blocks, frames records by Content-Length and
checks both digests on the way; it holds a block at a time, and a record's payload only where that is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.spread import hot_keys, salted_join, spread_join
from tideline.storage import materialise, new_path, read_table

BLOCK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(id) -> str:
    return f"<urn:x-page:{'null' if id is None else id}>"


def _id_of(record_id: str | None) -> int | None:
    tail = (record_id or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(id, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record; a revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", urllib.parse.quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")),
        ("WARC-Payload-Digest", sha(payload)),
        ("WARC-Block-Digest", sha(block)),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


class _Frame:
    """One record, fed piece by piece: the fields, then the block of Content-Length bytes (its HTTP head apart), then an empty line."""

    def __init__(self, keep_payload: bool):
        self.keep, self.head, self.fields, self.http, self.left, self.tail = keep_payload, bytearray(), None, None, 0, b""
        self.block, self.digest, self.size, self.payload = hashlib.sha1(), hashlib.sha1(), 0, bytearray()

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            data = self._until_empty_line(data)
            if data is None:
                return
            version, *lines = bytes(self.head).decode("utf-8").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a record: {version[:40]!r}")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            self.left, self.head = int(self.fields["content-length"]), bytearray()
        inside, self.tail = data[: self.left], self.tail + data[self.left :]
        self.left -= len(inside)
        if len(self.tail) > 4:
            raise ValueError("the block's length differs from Content-Length")
        self.block.update(inside)
        if self.http is None:
            inside = self._until_empty_line(inside)
            if inside is None:
                return
            self.http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in bytes(self.head).decode("latin-1").split("\r\n")[1:])}
        self.digest.update(inside)
        self.size += len(inside)
        if self.keep:
            self.payload += inside

    def _until_empty_line(self, data: bytes) -> bytes | None:
        """Collect ``head`` up to an empty line; what follows it, or None if it has not come yet."""
        start = max(0, len(self.head) - 3)
        self.head += data
        end = self.head.find(b"\r\n\r\n", start)
        if end < 0:
            return None
        rest = bytes(self.head[end + 4 :])
        del self.head[end:]
        return rest

    def done(self) -> dict:
        """The record's row, once the member has ended."""
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("the block's length differs from Content-Length")
        f, revisit = self.fields, self.fields["warc-type"] == "revisit"
        named = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:"))
        good = base64.b32decode(f["warc-block-digest"].removeprefix("sha1:")) == self.block.digest()
        return {
            "page_id": _id_of(f["warc-record-id"]),
            "url": f.get("warc-target-uri"),
            "record_type": f["warc-type"],
            "refers_to": _id_of(f.get("warc-refers-to")),
            "payload_digest": named.hex(),
            "payload_bytes": int((self.http or {}).get("content-length", 0)) if revisit else self.size,
            "payload": None if revisit or not self.keep else bytes(self.payload),
            "verified": good and (revisit or named == self.digest.digest()),
        }


def read_records(blocks: Iterable[bytes], keep_payload: bool = True, strict: bool = True) -> Iterator[dict]:
    """The rows of an archive's records in order. A gzip member that is cut off raises ``EOFError``, a record out of shape
    ``ValueError``; so does one whose digests disagree, unless ``strict`` is off (its row has ``verified`` false)."""
    inflate, frame, begun = zlib.decompressobj(31), _Frame(keep_payload), False
    for block in blocks:
        while block:
            begun = True
            frame.feed(inflate.decompress(block, BLOCK))
            block = inflate.unconsumed_tail
            if not block and not inflate.eof:
                frame.feed(inflate.decompress(b"", BLOCK))
            if inflate.eof:
                row = frame.done()
                if strict and not row["verified"]:
                    raise ValueError(f"digests of record {row['page_id']} disagree")
                yield row
                block, begun = inflate.unused_data, False
                inflate, frame = zlib.decompressobj(31), _Frame(keep_payload)
    if begun:
        raise EOFError("the last gzip member is cut off")


SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, verified boolean"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("verified", pa.bool_())])


def _rows(archives: Iterable[Iterable[bytes]], columns: list[str], strict: bool, max_bytes: int = 4 << 20, max_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    schema, rows, held = pa.schema([_ARROW.field(c) for c in columns]), [], 0
    for blocks in archives:
        for r in read_records(blocks, "payload" in columns, strict):
            rows.append({c: r[c] for c in columns})
            held += len(r["payload"] or b"")
            if held > max_bytes or len(rows) >= max_rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


def _opened(path: str) -> Iterator[bytes]:
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inside, compression=None) as f:
        while block := f.read(BLOCK):
            yield block


def _kind(columns: list[str]) -> str:
    return ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in columns)


def read_archives(manifest: DataFrame, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Records of the archives in ``manifest.archive``, streamed from the shared folder; ``strict`` as in ``read_records``."""
    columns = [f.name for f in _ARROW if not columns or f.name in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows((_opened(p) for b in batches for p in b.column("archive").to_pylist()), columns, strict)

    return manifest.select("archive").mapInArrow(run, _kind(columns))


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Records of all archives under ``path``, opened by Spark's own reader (any store that Spark reads). That reader gives
    whole files, of 2 GB at most; ``write_warc`` ends its archives far below."""
    columns = [f.name for f in _ARROW if not columns or f.name in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lambda c: (c[at : at + BLOCK] for at in range(0, len(c), BLOCK))
        yield from _rows((cut(c.as_py()) for b in batches for c in b.column("content")), columns, strict)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content").mapInArrow(run, _kind(columns))


def decide(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``page_id, digest, revisit, refers_to`` for each distinct pair of ``pages`` (page_id, payload, digest): of equal payloads of ``min_bytes`` or more the one with
    the largest page_id is the response."""
    keys = materialise(pages.select("page_id", "digest", F.length("payload").alias("size")).distinct(), "warc-keys")
    largest = keys.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return spread_join(keys, largest, ["digest"], F.col("page_id"), "left").select("page_id", "digest", again.alias("revisit"), F.when(again, F.col("last")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000, archive_bytes: int = 32 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``path`` and return the manifest ``archive, records``.

    Null html is an empty payload, null url an empty target. Rows that repeat a page are records of their own, of the same
    type. A null page_id is never a response to refer to while another id has the payload. An empty table writes
    nothing. Extra columns are ignored.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("digest", F.sha1("payload"))
    named = lambda df: df.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    hot = hot_keys(src.select("digest"), ["digest"])
    rows = salted_join(named(src), named(decide(src, min_bytes)).drop("page_id"), ["key", "digest"], F.monotonically_increasing_id(), hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, inside = fs.FileSystem.from_uri(path)
        store.create_dir(inside, recursive=True)
        task, out, name, size, count, done = TaskContext.get(), None, "", 0, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, size, count = store.open_output_stream(f"{inside}/{name}", compression=None), 0, 0
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = press.compress(record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"], date)) + press.flush()
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (f"{path}/{name}", count)], None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", count))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["archive", "records"])

    return materialise(rows.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(run, "archive string, records bigint"), "warc-manifest")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(read_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(manifest, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"])


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to, true AS verified
FROM g
"""
