"""Helpers that the training-data operators share: tables, the shared folder, Arrow chunks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on inside a task.
CHUNK_BYTES = 2 << 20
#: Rows up to which a side of longs (doc ids, fingerprints) may be broadcast: 8 MB of keys.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch at most, and its bytes, beyond which no row is added.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: Measured bytes up to which a stored side may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; only a local master gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Whole texts go to Python `BATCH_ROWS` or some `BATCH_BYTES` at a time at most: Spark's defaults of 10,000 rows and 64 MB
    are held by a task more than once, in buffers outside the heap and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    bound_batches(spark)
    return f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of materialize() that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts a side of counted rows within the limit; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def broadcast_within(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts a stored side whose measured bytes are within the limit; beyond it Spark shuffles both sides."""
    size = F.lit(16)
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        size = size + F.coalesce(F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 32 if kind == "array" else F.lit(8), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit else df


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """left joined with right, which has one row per key. Where a key holds very many rows of left, they go to up to
    `salts` tasks by a hash of the column `by`; right is repeated for the salts that occur."""
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    used = salted.select(F.col(key), "__salt").distinct().join(right, key)
    return salted.join(used, [key, "__salt"]).drop("__salt")


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def give_back() -> None:
    """What Arrow and the allocator keep for reuse goes back: the worker lives on, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that a slice holds about `limit` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, base + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()
