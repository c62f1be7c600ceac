"""Shared plumbing of the training-data operators: tables, words, durable cuts, components.

Words are taken from UTF-8 bytes.  ``bytes.split()`` separates at exactly the
ASCII white space ``[\\x20\\x09-\\x0D]``; ``ALNUM`` maps every other ASCII byte
that is no letter or digit to a space and lower-cases A-Z, so that its split
gives ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)

_own_root: dict[str, str] = {}
#: tables and archives in the shared folder that are still there, in the order they were named
made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where that is unset a temporary one, in local mode only: other machines couldn't read it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _own_root:
            _own_root[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        root = _own_root[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    made.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write to the shared folder, read again.  Survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in made:
        made.remove(path)


def release_since(spark: SparkSession, mark: int, *, keep: tuple[str, ...] = ()) -> None:
    """Deletes what was written since ``len(made)`` was ``mark``: for results that have been written themselves."""
    for path in [x for x in made[mark:] if x not in keep]:
        release(spark, path)


def bounded(df: DataFrame, rows: int, row_bytes: int, most_bytes: int = 32 << 20) -> DataFrame:
    """The frame with a hint to broadcast it if ``rows`` rows of at most ``row_bytes`` bytes keep to the bound; else as it is, for a join by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= most_bytes else df


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


_worker_cache: dict[object, object] = {}


def worker_cache(key: object, make: Callable[[], object] = lambda: None):  # noqa: ANN201
    """One object a worker process that outlives tasks; another operator's is dropped, so that they don't add up."""
    if key not in _worker_cache:
        if _worker_cache:
            _worker_cache.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)
        _worker_cache[key] = make()
    return _worker_cache[key]


def per_batch(
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that sets up once a task and maps batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(make.__qualname__)
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):  # keeps what stands in Python's memory small
                if (out := f(batch.slice(i, 1024))) is not None:
                    yield out

    return run


def hash_share(column: str, share):  # noqa: ANN001, ANN201
    """True for about that share of the rows, chosen by a hash: a cheap bound in front of an exact choice by the same hash."""
    return F.xxhash64(column).cast("double") < F.lit(float(-(2**63))) + share * F.lit(float(2**64))


def held_out(doc_id: str = "doc_id"):
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long edges -> (node, root) with root the smallest node of the component.

    Alternating large-star and small-star rounds on distributed edges.  Every
    round is written to the shared folder, so nothing but two numbers a round
    (edge count and hash sum, to see the fixed point) comes to the driver.
    Minima are pre-aggregated map-side; the joins back may be split by AQE at hubs.
    Self loops are ignored; nodes without an edge don't appear in the result.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, path = materialize(e, "cc")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p"))
            .select(F.col("p.v").alias("u"), F.col("p.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        nxt, nxt_path = materialize(small, "cc")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        release(spark, path)
        e, path = nxt, nxt_path
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected_components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
