"""Starting and draining streams."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import scratch_path

log = logging.getLogger(__name__)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: Sequence[str] = ()):
    """Durable Parquet sink; restarting with the same checkpoint resumes exactly once."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


def drain(stream: DataFrame, name: str = "stream", partition_by: Sequence[str] = ()) -> DataFrame:
    """Process what is available, then read back what the sink holds."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-state")
    query = to_table(stream, out, state, partition_by=partition_by)
    query.awaitTermination()
    return spark.read.schema(T.StructType(stream.schema.fields)).parquet(out)


def drain_latest(stream: DataFrame, keys: Sequence[str], name: str = "stream") -> DataFrame:
    """For running aggregates in update mode: write each batch, keep the newest row per key."""
    from pyspark.sql import functions as F

    spark = stream.sparkSession
    out, state = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())]))
    rest = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), "_batch")
    return rows.parquet(f"{out}/batch=*").groupBy(*keys).agg(newest.alias("s")).select(*keys, "s.*")


def fan_out(
    stream: DataFrame, consumers: Mapping[str, Callable[[DataFrame, int], None]], checkpoint: str, attempts: int = 4
) -> dict[str, Exception | None]:
    """Give every micro-batch to all consumers, each with a position of its own; name -> None or the last error.

    A consumer is a query with its own checkpoint below ``checkpoint``, so the source is read once for each. One that fails is
    started again at the batch it failed on, with the same number and rows, while the others go on; a consumer that
    writes by batch number thus has every row exactly once. After ``attempts`` starts its error is given
    back, and a later call with the same checkpoint goes on where it stopped.
    """

    def start(name: str):
        return (
            stream.writeStream.foreachBatch(consumers[name])
            .option("checkpointLocation", f"{checkpoint}/{name}")
            .trigger(availableNow=True)
            .start()
        )

    running = {name: start(name) for name in consumers}
    ended: dict[str, Exception | None] = {}
    for attempt in range(1, attempts + 1):
        failed = []
        for name, query in running.items():
            try:
                query.awaitTermination()
                ended[name] = None
            except StreamingQueryException as error:
                log.warning("consumer %s failed at attempt %d: %s", name, attempt, error)
                ended[name] = error
                failed.append(name)
        if not failed or attempt == attempts:
            return ended
        running = {name: start(name) for name in failed}
    return ended
