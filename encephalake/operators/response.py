"""Tests of how recordings respond to a change of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import ALPHA_RESPONSE_CHANNELS
from .spectral import alpha_summary, band_powers, welch
from .windows import equal_segments, extents


def _response(powers: DataFrame, value: str, threshold: float) -> DataFrame:
    """Mean of ``value`` under labels 0 and 1 per channel, the ratio, and the verdict."""
    per_channel = powers.groupBy("session_id", "channel").agg(
        F.coalesce(F.avg(F.when(F.col("label") == 0, F.col(value))), F.lit(0.0)).alias("mean_0"),
        F.coalesce(F.avg(F.when(F.col("label") == 1, F.col(value))), F.lit(0.0)).alias("mean_1"),
    ).withColumn("ratio", F.col("mean_1") / (F.col("mean_0") + 1e-10))
    overall = per_channel.groupBy("session_id").agg(F.avg("ratio").alias("mean_ratio"))
    return per_channel.join(overall, "session_id").withColumn("passed", F.col("mean_ratio") > threshold)


_KEYS = ["session_id", "channel", "channel_idx"]


def _segment_powers(samples: DataFrame, labels: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    spans = equal_segments(samples, labels, _KEYS, ends).withColumnRenamed("seg_len", "span_len")
    group = [*_KEYS, "seg", "label"]
    return band_powers(welch(spans, group), group)


def alpha_response(samples: DataFrame, labels: DataFrame, threshold: float = 1.2) -> DataFrame:
    """Relative alpha with eyes closed against open, on the occipital channels.

    Sessions without any of them fall back to the first three channels that they have. Channels and lengths
    come from one aggregate of the samples.
    """
    ends = extents(samples, _KEYS)
    named = F.col("channel").isin(ALPHA_RESPONSE_CHANNELS)
    montage = Window.partitionBy("session_id")  # the channels of a session, not its samples
    placed = ends.withColumn("_has", F.max(named).over(montage)).withColumn("_place", F.row_number().over(montage.orderBy("channel_idx")))
    tested = placed.where(F.when(F.col("_has"), named).otherwise(F.col("_place") <= 3)).drop("_has", "_place")
    return _response(_segment_powers(samples, labels, tested), "alpha", threshold)


def slowing_response(samples: DataFrame, labels: DataFrame, threshold: float = 1.3) -> DataFrame:
    """Delta plus theta under label 1 against label 0, on every channel."""
    slow = _segment_powers(samples, labels).withColumn("slow", F.col("delta") + F.col("theta"))
    return _response(slow, "slow", threshold)


def alpha_blocking(spans: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Absolute alpha of closed segments over open ones, per channel and session.

    ``spans`` has session_id, channel, segment (a name holding 'open' or
    'closed'), pos and span_len.
    """
    keys = ["session_id", "channel", "segment"]
    alpha = alpha_summary(welch(spans, keys), keys)
    per_channel = alpha.groupBy("session_id", "channel").agg(
        F.avg(F.when(F.col("segment").contains("open"), F.col("alpha_power"))).alias("open_power"),
        F.avg(F.when(F.col("segment").contains("closed"), F.col("alpha_power"))).alias("closed_power"),
    ).where(F.col("open_power").isNotNull() & F.col("closed_power").isNotNull())
    ratio = F.when(F.col("open_power") > 0, F.col("closed_power") / F.col("open_power")).otherwise(0.0)
    rows = per_channel.withColumn("ratio", ratio)
    verdict = rows.groupBy("session_id").agg(F.bool_or(F.col("ratio") > threshold).alias("passed"))
    return rows.join(verdict, "session_id")
