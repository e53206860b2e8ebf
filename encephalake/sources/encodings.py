"""Stored encodings, the interchange document, and template libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import SAMPLE_RATE
from ..schema import PN, TEMPLATES


def save_encoding(pn: DataFrame, path: str) -> None:
    pn.select(*PN.names).repartition("session_id", F.expr("sample_idx div 1000000")).sortWithinPartitions(
        "session_id", "channel", "sample_idx"
    ).write.mode("append").partitionBy("session_id").parquet(path)


def load_encoding(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PN).parquet(path)


def interchange_pieces(pn: DataFrame, piece: int = 4096) -> DataFrame:
    """(session_id, channel, piece, n_samples, a, b, c): bounded slices of each channel's arrays."""
    packed = F.array_sort(F.collect_list(F.struct("sample_idx", "a", "b", "c")))
    return (
        pn.groupBy("session_id", "channel", F.expr(f"sample_idx div {piece}").alias("piece"))
        .agg(packed.alias("g"))
        .select(
            "session_id", "channel", "piece", F.size("g").alias("n_samples"),
            F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.col("g.c").alias("c"),
        )
    )


def interchange_documents(
    pn: DataFrame, subject_id: str = "S000", fs: float = SAMPLE_RATE, config: dict[str, float | str] | None = None,
    with_timestamps: bool = False, piece: int = 4096,
) -> DataFrame:
    """(session_id, piece, document): the JSON contract of a session.

    A document holds at most ``piece`` samples of all channels, so a long
    recording is a numbered sequence of documents; a recording of up to ``piece``
    samples is exactly one.  Metadata repeats in each.
    """
    slices = interchange_pieces(pn, piece)
    entry = F.struct("channel", F.struct("a", "b", "c").alias("v"))
    docs = slices.groupBy("session_id", "piece").agg(
        F.array_sort(F.collect_list(entry)).alias("g"), F.max("n_samples").alias("n_samples")
    )
    meta = [
        F.lit(subject_id).alias("subject_id"),
        F.col("session_id"),
        F.lit(float(fs)).alias("sample_rate"),
        F.col("g.channel").alias("channels"),
        F.col("n_samples"),
    ]
    if config is not None:
        meta.append(F.struct(*[F.lit(v).alias(k) for k, v in config.items()]).alias("pn_config"))
    fields = [
        F.struct(*meta).alias("metadata"),
        F.map_from_arrays(F.col("g.channel"), F.col("g.v")).alias("pn_parameters"),
    ]
    if with_timestamps:
        first = F.col("piece") * piece
        at = F.transform(F.sequence(first, first + F.col("n_samples") - 1), lambda i: i / F.lit(float(fs)))
        fields.append(at.alias("timestamps"))
    return docs.select("session_id", "piece", F.to_json(F.struct(*fields)).alias("document"))


def save_templates(templates: DataFrame, path: str) -> None:
    templates.select(*TEMPLATES.names).write.mode("append").parquet(path)


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEMPLATES).parquet(path)
