"""WARC archives: a deduplicating writer and a splittable reader.

Writing.  Every row becomes one gzip member that holds one record.  Of rows with equal
payloads of at least ``min_revisit_bytes`` bytes the one with the largest key is a ``response``; the others are
``revisit`` records that name it and carry only the HTTP header.  Payloads meet by SHA-1 digest:
counts are pre-aggregated, and the repeated digests are joined back to the rows: broadcast if their counted number keeps to
a bound of bytes, so that no page is moved; else by a shuffle under salts, as many as the most frequent digest needs for
``ROWS_A_SALT`` rows each.  Tasks write files of
their own in the shared folder and return their names; only files of tasks that
succeeded are listed, so retried tasks add no records.

Reading.  A task gets a byte range.  It looks for the gzip magic, takes a candidate only if it
inflates to a WARC header, of any length, that can be decoded, and owns all records that start inside its range;
the last may end beyond.  Ranges are cut on the executors from the list of archives, of which there is one a writing task.  From the first valid start on, members follow one another.
Corrupt members are skipped to the next valid start.

Defined cases: null payloads and urls are empty; null keys write an empty key, read back as null, and
count as smaller than any other; rows with equal payloads and equal largest keys are all responses;
an empty table writes no archive and reads to no rows; payloads and urls of any length are written and read whole, in the memory of a task;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, new_path, texts

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS_A_SALT, DIGEST_BYTES = 20_000, 96
CHUNK = 1 << 20
DATE = "2000-01-01T00:00:00Z"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: str, url: str, payload: bytes, refers_to: str | None, refers_url: str = "", level: int = 4) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    clean = "".join(c if c > " " else "%%%02X" % ord(c) for c in url)
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:key:{key}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:key:{refers_to}>"]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def write_warc(
    pages: DataFrame,
    path: str | None = None,
    *,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_revisit_bytes: int = 0,
    bound_bytes: int = 32 << 20,
) -> list[tuple[str, int]]:
    """Writes the archives; returns their names and sizes (one file a task at most)."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    src = pages.select(
        F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body")
    ).withColumn("sha", F.unhex(F.sha1("body")))
    repeated = src.where(F.octet_length("body") >= min_revisit_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("key").alias("top_key")).where("n > 1")
    repeated, _ = materialize(repeated.select("sha", "n", "top_key", F.lit(True).alias("again")), "repeated")
    size, most = repeated.agg(F.count("*"), F.max("n")).first()
    if size * DIGEST_BYTES <= bound_bytes:
        decided = src.join(F.broadcast(repeated.drop("n")), "sha", "left")
    else:
        salts = max(1, -(-most // ROWS_A_SALT))
        salted = repeated.drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        decided = src.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(salts)).cast("int")).join(salted, ["sha", "salt"], "left")
    rows = decided.select(
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"),
        "url",
        "body",
        F.when(F.col("again") & ~F.col("key").eqNullSafe(F.col("top_key")), F.coalesce(F.col("top_key").cast("string"), F.lit(""))).alias("refers"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size = None, f"{path}/{uuid.uuid4().hex}.warc.gz", 0
        for b in batches:
            for k, u, body, refers in zip(*(b.column(c) for c in ("key", "url", "body", "refers")), strict=True):
                member = record(k.as_py(), u.as_py(), body.as_py(), refers.as_py())
                if out is None:
                    fs, local = _fs(name)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None, buffer_size=CHUNK)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["path", "size"])

    return [(r.path, r.size) for r in rows.mapInArrow(write, "path string, size long").collect()]


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC header")
    out = {}
    for line in lines[1:]:
        name, sep, value = line.partition(":")
        if not sep:
            raise ValueError("not a header line")
        out[name.strip().lower()] = value.strip()
    if "warc-type" not in out or not out.get("content-length", "").isdigit():
        raise ValueError("no WARC header")
    return out


class RangeReader:
    """The records that start in [start, end) of a file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        fs, local = _fs(path)
        self.file = fs.open_input_file(local)
        self.total = self.file.size()
        self.start, self.end = start, min(end, self.total)
        self.base, self.data = start, b""

    def _at(self, pos: int, size: int) -> bytes:
        """Up to ``size`` bytes at ``pos`` through a window that only moves forward."""
        if not (self.base <= pos and pos + size <= self.base + len(self.data)):
            self.base, self.data = pos, self.file.read_at(min(max(size, CHUNK), max(0, self.total - pos)), pos)
        return self.data[pos - self.base : pos - self.base + size]

    def _member(self, pos: int, header_only: bool) -> tuple[dict[str, str], bytes, int] | None:
        """Headers, block and end of the member at ``pos``; None if there is none."""
        inflate, whole, at, head = zlib.decompressobj(31), bytearray(), pos, None
        try:
            while not inflate.eof:
                chunk = self._at(at, 1 << 14 if header_only else 1 << 16)
                if not chunk:
                    return None
                seen = max(0, len(whole) - 3)
                whole += inflate.decompress(chunk)
                at += len(chunk)
                if head is None:
                    cut = whole.find(b"\r\n\r\n", seen)
                    if cut >= 0:
                        head = _headers(bytes(whole[:cut]))
                        if header_only:
                            return head, b"", at
                    elif not whole.startswith(b"WARC/1."[: len(whole)]):  # a header of any length is read, up to the member's end
                        return None
            if head is None:
                return None
        except (zlib.error, ValueError, UnicodeDecodeError):
            return None
        size = int(head["content-length"])
        block = bytes(memoryview(whole)[cut + 4 : cut + 4 + size])
        return (head, block, at - len(inflate.unused_data)) if len(block) == size else None

    def _next_start(self, pos: int) -> int | None:
        while pos < self.end:
            window = self._at(pos, min(CHUNK, self.end + len(MAGIC) - 1 - pos))
            hit = window.find(MAGIC)
            if hit < 0:
                pos += max(1, len(window) - len(MAGIC) + 1)
            elif pos + hit < self.end and self._member(pos + hit, True):
                return pos + hit
            else:
                pos += hit + 1
        return None

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, int]]:
        pos = self._next_start(self.start)
        while pos is not None and pos < self.end:
            member = self._member(pos, False)
            if member is None:
                pos = self._next_start(pos + 1)
                continue
            yield member[0], member[1], pos
            pos = member[2]
            if pos < self.end and self._at(pos, 3) != MAGIC:
                pos = self._next_start(pos)


def read_warc(spark: SparkSession, archives: list[tuple[str, int]], *, range_bytes: int = 16 << 20, payload: bool = True) -> DataFrame:
    """record_key, record_type, refers_to_key, url, payload_bytes, payload_digest [, payload]: a row a record.

    A response's payload is held against its digest; a mismatch raises.
    """
    schema = "record_key string, record_type string, refers_to_key string, url string, payload_bytes long, payload_digest string" + ", payload binary" * payload
    archives = [(p, n) for p, n in archives if n]
    if not archives:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_key", "record_type", "refers_to_key", "url", "payload_bytes", "payload_digest"] + ["payload"] * payload
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * payload
        for b in batches:
            for path, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                rows, held = [], 0
                for head, block, at in RangeReader(path, start, end):
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind not in ("response", "revisit"):
                        continue
                    size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
                    if kind == "response":
                        own = digest_of(body)
                        if digest and own != digest or len(body) != size:
                            raise ValueError(f"{path} at {at}: the payload doesn't have its digest or length")
                        digest = own
                    refers = head.get("warc-refers-to")
                    rows.append((head["warc-record-id"][9:-1] or None, kind, refers and (refers[9:-1] or None), head.get("warc-target-uri", ""), size, digest) + ((body,) if payload else ()))
                    held += len(body) if payload else 200
                    if held > 16 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    tasks = min(10_000, max(1, sum(-(-n // range_bytes) for _, n in archives)))
    whole = spark.createDataFrame(archives, "path string, size long").repartition(min(len(archives), tasks))
    cut = whole.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    src = cut.select("path", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end")).repartition(tasks)
    return src.mapInArrow(read, schema)
