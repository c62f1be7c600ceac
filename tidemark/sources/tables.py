"""Reading observations at the edge, and model payloads as Parquet with an identity."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """A table of a columnar or text format; text formats need a declared schema."""
    if kind not in FORMATS:
        raise ValueError(f"formats are {', '.join(FORMATS)}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind)
    reader = reader.schema(schema) if schema is not None else reader
    return (reader.option("header", True) if kind == "csv" else reader).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.format(kind).mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    (writer.option("header", True) if kind == "csv" else writer).save(path)


META = ("name", "version", "kind", "created", "source", "description")
MAX_FIELDS = 4096


def payload_identity(fields: dict[str, np.ndarray], meta: dict[str, str]) -> str:
    """SHA-256 over metadata and every field's name, type, shape and bytes."""
    h = hashlib.sha256()
    for k in META:
        h.update(f"{k}={meta[k]}\n".encode())
    for k in sorted(fields):
        a = np.ascontiguousarray(fields[k])
        h.update(f"{k}:{a.dtype.str}:{a.shape}\n".encode() + a.tobytes())
    return h.hexdigest()


def save_payload(spark: SparkSession, path: str, fields: dict[str, np.ndarray], meta: dict[str, str]) -> str:
    if len(fields) > MAX_FIELDS or set(meta) != set(META):
        raise ValueError(f"a payload has at most {MAX_FIELDS} fields and the metadata {', '.join(META)}")
    own = payload_identity(fields, meta)
    rows = [(k, np.asarray(a).dtype.str, list(np.asarray(a).shape), bytearray(np.ascontiguousarray(a).tobytes())) for k, a in fields.items()]
    df = spark.createDataFrame(rows, "name string, dtype string, shape array<long>, data binary")
    for k, v in meta.items():
        df = df.withColumn(f"meta_{k}", F.lit(v))
    df.withColumn("identity", F.lit(own)).write.mode("overwrite").parquet(path)
    return own


def load_payload(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    """Fields and metadata; raises if the content doesn't have its identity."""
    rows = spark.read.parquet(path).collect()  # at most MAX_FIELDS rows
    fields = {r.name: np.frombuffer(bytes(r.data), r.dtype).reshape([int(x) for x in r["shape"]]) for r in rows}
    meta = {k: rows[0][f"meta_{k}"] for k in META} if rows else {}
    if rows and payload_identity(fields, meta) != rows[0].identity:
        raise ValueError("PAYLOAD_IDENTITY_MISMATCH")
    return fields, meta
