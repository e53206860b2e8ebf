"""Streaming operators.  Samples arrive in order from a device; the watermark
only lets Spark drop state."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import BANDS, BENCH, RAIL_UV, SAMPLE_RATE
from ..functions import kernels
from ..functions.layout import sorted_values
from ..operators.quality import grade, quality_metrics


def with_event_time(samples: DataFrame, fs: float = SAMPLE_RATE, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """Event time from the sample index (8 ms apart at 125 Hz)."""
    micros = F.unix_micros(F.lit(start).cast("timestamp")) + F.round(F.col("sample_idx") * 1e6 / fs).cast("bigint")
    return samples.withColumn("ts", F.timestamp_micros(micros))


def sliding_quality(
    stream: DataFrame, keys: Sequence[str], window: str = "2 seconds", slide: str = "1 second",
    delay: str = "1 second", n_full: int | None = None, profile: str = BENCH,
) -> DataFrame:
    """Railed percent, std, line ratio and status per sliding event-time window.

    The window's samples (2 s, so at most 250 per channel) are kept as state and
    graded in the same micro-batch; ``n_full`` keeps complete windows only.
    """
    windows = (
        stream.withWatermark("ts", delay)
        .groupBy(*keys, F.window("ts", window, slide).alias("w"))
        .agg(sorted_values("sample_idx", "uv").alias("x"), F.count(F.lit(1)).alias("n"))
    )
    if n_full is not None:
        windows = windows.where(F.col("n") == n_full)
    m = quality_metrics(F.col("x"), RAIL_UV[profile])
    rows = windows.select(*keys, F.col("w.start").alias("start_ts"), "n", m.alias("m"))
    return grade(rows.select(*keys, "start_ts", "n", "m.*"), profile)


def sliding_std(
    stream: DataFrame, keys: Sequence[str], window: str, slide: str, delay: str
) -> DataFrame:
    """Count, mean and std per sliding window; state is a handful of numbers per window."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(*keys, F.window("ts", window, slide).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg("uv").alias("mean_uv"), F.stddev_pop("uv").alias("std_uv")
        )
        .select(*keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "mean_uv", "std_uv")
    )


def sliding_band_power(
    stream: DataFrame, keys: Sequence[str], window: str = "1 second", slide: str = "250 milliseconds",
    delay: str = "1 second", bands: dict[str, tuple[float, float]] = BANDS, fs: float = SAMPLE_RATE,
) -> DataFrame:
    """Relative band powers of each window's spectrum (one segment)."""
    windows = (
        stream.withWatermark("ts", delay)
        .groupBy(*keys, F.window("ts", window, slide).alias("w"))
        .agg(sorted_values("sample_idx", "uv").alias("x"))
    )
    fields = ",".join(f"{b}:double" for b in bands)

    @F.pandas_udf(f"struct<{fields}>")
    def powers(x: pd.Series) -> pd.DataFrame:
        rows = []
        for v in x:
            p = kernels.density(np.asarray(v)[None, :], fs, "hann")[0]
            f = np.arange(len(p)) * fs / len(v)
            total = np.trapezoid(p, f) or 1e-10
            rows.append([np.trapezoid(p[(f >= lo) & (f < hi)], f[(f >= lo) & (f < hi)]) / total for lo, hi in bands.values()])
        return pd.DataFrame(rows, columns=list(bands))

    out = windows.select(*keys, F.col("w.start").alias("start_ts"), F.size("x").alias("n"), powers("x").alias("p"))
    return out.select(*keys, "start_ts", "n", "p.*")


def feedback(powers: DataFrame, baseline: DataFrame, keys: Sequence[str], control: str = "is_control") -> DataFrame:
    """Amplitude clip(1 - min((alpha - base) / (2 base), 1), .1, 1); NaN in control blocks."""
    base = F.col("base_alpha")
    raw = 1 - F.least((F.col("alpha") - base) / (2 * base), F.lit(1.0))
    amp = F.greatest(F.lit(0.1), F.least(F.lit(1.0), raw))
    return powers.join(baseline, list(keys)).withColumn(
        "amplitude", F.when(F.col(control), F.lit(float("nan"))).otherwise(amp)
    )


def running_totals(stream: DataFrame, keys: Sequence[str] = ("session_id",), fs: float = SAMPLE_RATE) -> DataFrame:
    """Samples so far and elapsed seconds per key."""
    return stream.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), (F.max("sample_idx") + 1).alias("n_samples")
    ).withColumn("elapsed_sec", F.col("n_samples") / F.lit(fs))


def fixed_chunks(
    stream: DataFrame, keys: Sequence[str], size: int = 256, delay: str = "10 seconds", fs: float = SAMPLE_RATE
) -> DataFrame:
    """Complete count-based chunks.

    All samples of a chunk share the event time at which it ends, which is the
    watermark column, so a chunk's state is dropped once the stream is past it.
    """
    left = F.lit(size) - F.col("sample_idx") % size
    closes = F.timestamp_micros(F.unix_micros("ts") + F.round(left * 1e6 / fs).cast("bigint"))
    return (
        stream.withColumn("closes", closes)
        .withWatermark("closes", delay)
        .groupBy(*keys, F.expr(f"sample_idx div {size}").alias("chunk_no"), "closes")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("uv").alias("mean_uv"))
        .where(F.col("n") == size)
        .select(*keys, "chunk_no", "closes", "n", "mean_uv")
    )


def time_axis(samples: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(s_session, sample_idx, s_ts): each time point once, whichever channels have it.

    Repeats are dropped within the watermark, so the state is what arrived in that time.
    """
    points = samples.select(F.col("session_id").alias("s_session"), "sample_idx", F.col("ts").alias("s_ts"))
    return points.withWatermark("s_ts", delay).dropDuplicatesWithinWatermark(["s_session", "sample_idx"])


def insert_markers(samples: DataFrame, marks: DataFrame, delay: str = "10 seconds", fs: float = SAMPLE_RATE) -> DataFrame:
    """Stream-stream join: each mark takes the index of the sample nearest to its time.

    ``marks`` is (session_id, ts, marker_id, label). The time axis is that of all channels together, so a
    montage may lack any of them. The time bound of half a sample lets both sides drop state. Both sides meet by
    seconds, in which a mark is once or twice and a sample once, so a mark is compared with a second's samples only.
    """
    half = F.make_dt_interval(secs=F.lit(0.5 / fs))
    s = time_axis(samples, delay).withColumn("s_second", F.unix_seconds("s_ts"))
    seconds = F.array_distinct(F.array(F.unix_seconds(F.col("ts") - half), F.unix_seconds(F.col("ts") + half)))
    m = marks.withWatermark("ts", delay).withColumn("second", F.explode(seconds))
    on = (F.col("session_id") == F.col("s_session")) & (F.col("second") == F.col("s_second")) & _nearest(fs)
    return m.join(s, on).select("session_id", F.col("sample_idx").alias("sample_index"), "marker_id", "label")


def _nearest(fs: float) -> Column:
    """Sample time within half a sample of the mark; of two equally near samples the earlier one."""
    half = F.make_dt_interval(secs=F.lit(0.5 / fs))
    return (F.col("s_ts") >= F.col("ts") - half) & (F.col("s_ts") < F.col("ts") + half)
