"""What the text operators share: tables in the shared folder, files, joins that survive hot keys."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encephalake.session import shared_dir

#: The white space that separates words.
WHITE = r"[\x20\x09-\x0D]"
#: Rows of a few short columns that may be broadcast once they have been counted: about 10 MB.
BROADCAST_ROWS = 100_000
#: Bytes of rows that Spark gives to a Python worker at once.
BATCH_BYTES = 4 << 20


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold ``BATCH_BYTES`` and a row at most, not 10,000 texts; smaller ones stay as set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path inside it; a bare path is local to what mounts the shared folder."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, which a cluster's owner sets to suit the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_by_count(left: DataFrame, right: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """Left join of many rows to one row per key, where ``count`` has the key's rows on the left.

    Up to ``BROADCAST_ROWS`` keys, counted first, are broadcast. Beyond that, at most P keys can each hold more than 1/P of ``total`` rows: those (P rows at most) are
    broadcast, all others meet in a shuffle where no key is large. Keys are not null.
    """
    parts = partitions(left.sparkSession)
    right = right.withColumnRenamed(on, "_key")
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), F.col(on) == F.col("_key"), "left").drop("_key")
    hot = F.broadcast(right.where(F.col(count) * parts > total))
    same = F.col(on) == F.col("_key")
    cold = left.join(hot.select("_key"), same, "left_anti")
    rest = right.where(F.col(count) * parts <= total)
    return left.join(hot, same).drop("_key").unionByName(cold.join(rest, same, "left").drop("_key"))


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``rows`` whose columns named in ``keys`` are no row of ``keys``; nulls are equal. Broadcast only if counted small."""
    named = keys.toDF(*[f"_{i}" for i in range(len(keys.columns))])
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys.columns)]
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(named) if small else named, same, "left_anti")


def only(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``rows`` whose ``on`` is a row of ``keys``, which are distinct. Broadcast only if counted small: then ``rows`` are not shuffled."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if small else keys, on, "left_semi")


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` holds about ``limit`` bytes; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_list(column: pa.Array) -> list[bytes]:
    """A text column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sample_per_group(rows: DataFrame, group: str, key: str, size: int, fan: int = 64) -> DataFrame:
    """``size`` rows of each group by the smallest hash of ``key``; two levels, so that no task sees a whole group."""
    from pyspark.sql import Window

    hashed = rows.withColumn("_h", F.xxhash64(key)).withColumn("_b", F.pmod("_h", F.lit(fan)))
    for by in ((group, "_b"), (group,)):
        order = Window.partitionBy(*by).orderBy("_h", key)
        hashed = hashed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).drop("_r")
    return hashed.drop("_h", "_b")
