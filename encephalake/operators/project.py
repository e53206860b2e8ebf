"""Row-wise work: units, montage lookups, subsets, crops and overlays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import (
    CURRENT_MONTAGE,
    MONTAGES,
    REJECT_LABELS,
    SAMPLE_RATE,
    SPECTRUM_PRIORITY,
    group_table,
    montage_table,
    subset_table,
)
from ..functions.expr import channel_name, rank_in, seconds
from ..functions.layout import KEYS, place_join, section_join


def to_volts(df: DataFrame, value: str = "uv", out: str = "volts") -> DataFrame:
    return df.withColumn(out, F.col(value) * F.lit(1e-6))


def to_microvolts(df: DataFrame, value: str = "volts", out: str = "uv") -> DataFrame:
    return df.withColumn(out, F.col(value) * F.lit(1e6))


def relabel(samples: DataFrame, target: str = CURRENT_MONTAGE, from_version: str = "unknown") -> DataFrame:
    """Give channels the names of another montage version and record the change."""
    if target not in MONTAGES:
        raise ValueError(f"unknown montage version: {target}; known: {sorted(MONTAGES)}")
    return (
        samples.withColumn("channel", channel_name(F.col("channel_idx"), target))
        .withColumn("montage_version", F.lit(target))
        .withColumn("relabeled_from_legacy", F.lit(True))
        .withColumn("relabeled_from_version", F.lit(from_version))
    )


def board_of(channel_no: Column, boards: tuple[str, str] = ("main", "extension")) -> Column:
    """First eight channels, then the next eight; anything else is an error."""
    return (
        F.when(channel_no.between(1, 8), F.lit(boards[0]))
        .when(channel_no.between(9, 16), F.lit(boards[1]))
        .otherwise(F.raise_error(F.concat(F.lit("channel number out of range 1..16: "), channel_no)))
    )


def with_channel_facts(
    df: DataFrame, version: str = CURRENT_MONTAGE, boards: tuple[str, str] = ("main", "extension")
) -> DataFrame:
    """Join position, board and wire colour by channel number (a 16-row table)."""
    facts = montage_table(df.sparkSession, boards).where(F.col("version") == version)
    return df.withColumn("channel_no", F.col("channel_idx") + 1).join(
        F.broadcast(facts.drop("version")), "channel_no"
    )


def with_groups(df: DataFrame) -> DataFrame:
    """One row per named region a channel belongs to."""
    return df.join(F.broadcast(group_table(df.sparkSession)), "channel")


def channel_subset(df: DataFrame, subset: str = "8") -> DataFrame:
    wanted = subset_table(df.sparkSession).where(F.col("subset") == subset).select("channel")
    return df.join(F.broadcast(wanted), "channel", "left_semi")


def crop(df: DataFrame, tmin: float, tmax: float, fs: float = SAMPLE_RATE) -> DataFrame:
    """Keep tmin <= t <= tmax, both ends included, as a range of sample indexes."""
    lo, hi = int(np.ceil(round(tmin * fs, 6))), int(np.floor(round(tmax * fs, 6)))
    return df.where(F.col("sample_idx").between(lo, hi))


def latest(df: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last n samples of every key (all of them if there are fewer)."""
    ends = df.groupBy(*keys).agg(F.min("sample_idx").alias("_first"), F.max("sample_idx").alias("_last"))
    joined = section_join(df, ends, keys, "_last", first="_first")
    return joined.where(F.col("sample_idx") > F.col("_last") - n).drop("_first", "_last")


def full_chunks(df: DataFrame, size: int = 256, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of complete fixed-count chunks: one row per chunk with its bounds."""
    return (
        df.groupBy(*keys, F.expr(f"sample_idx div {size}").alias("chunk_no"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("sample_idx").alias("first_idx"),
            F.max("sample_idx").alias("last_idx"),
            F.avg("uv").alias("mean_uv"),
        )
        .where(F.col("n") == size)
    )


def at_index(pn: DataFrame, index: Column | int, channels: Sequence[str] | None = None) -> DataFrame:
    out = pn.where(F.col("sample_idx") == index)
    return out if channels is None else out.where(F.col("channel").isin(list(channels)))


# ---------------------------------------------------------------- overlays


def overlay_sine(
    df: DataFrame, channels: Sequence[str], freq: float = 10.0, amp: float = 20.0, fs: float = SAMPLE_RATE
) -> DataFrame:
    wave = amp * F.sin(2 * np.pi * freq * seconds(F.col("sample_idx"), fs))
    return df.withColumn("uv", F.col("uv") + F.when(F.col("channel").isin(list(channels)), wave).otherwise(0.0))


def overlay_bumps(
    df: DataFrame,
    onsets: DataFrame,
    channels: Sequence[str],
    amp: float = 10.0,
    latency_sec: float = 0.3,
    width_sec: float = 0.1,
    fs: float = SAMPLE_RATE,
) -> DataFrame:
    """Add a Gaussian after every onset.

    Each onset becomes the sample indexes it reaches (eight widths), summed per
    index, so the samples need only an equi join.  Onsets whose peak lies past
    the recording are skipped.
    """
    latency, width = int(latency_sec * fs), int(width_sec * fs)
    ends = df.groupBy("session_id").agg((F.max("sample_idx") + 1).alias("_n"))
    peaks = place_join(
        onsets.select("session_id", (F.col("sample_index") + latency).alias("peak")), ends, ["session_id"], "peak"
    ).where("peak < _n")
    reach = peaks.withColumn(
        "sample_idx",
        F.explode(
            F.sequence(F.greatest(F.lit(0), F.col("peak") - 4 * width), F.col("peak") + 4 * width - 1)
        ),
    ).where("sample_idx < _n")
    z = (F.col("sample_idx") - F.col("peak")) / F.lit(float(width))
    bumps = reach.groupBy("session_id", "sample_idx").agg(F.sum(amp * F.exp(-0.5 * z * z)).alias("_bump"))
    hit = F.when(F.col("channel").isin(list(channels)), F.coalesce("_bump", F.lit(0.0))).otherwise(0.0)
    return (
        df.join(bumps, ["session_id", "sample_idx"], "left")
        .withColumn("uv", F.col("uv") + hit)
        .drop("_bump")
    )


def overlay_burst(
    df: DataFrame,
    channels: Sequence[str],
    start: int,
    length: int,
    freq: float = 40.0,
    amp: float = 5.0,
    fs: float = SAMPLE_RATE,
) -> DataFrame:
    """Add a Hann-shaped sine burst over [start, min(start + length, n))."""
    ends = df.groupBy("session_id").agg(F.min("sample_idx").alias("_first"), (F.max("sample_idx") + 1).alias("_n"))
    rows = section_join(df, ends, ["session_id"], "_n", first="_first").drop("_first")
    m = F.least(F.lit(start + length), F.col("_n")) - start
    j = F.col("sample_idx") - start
    hann = F.when(m > 1, 0.5 - 0.5 * F.cos(2 * np.pi * j / (m - 1))).otherwise(1.0)
    wave = amp * hann * F.sin(2 * np.pi * freq * seconds(j, fs))
    inside = F.col("channel").isin(list(channels)) & (j >= 0) & (j < m)
    return rows.withColumn("uv", F.col("uv") + F.when(inside, wave).otherwise(0.0)).drop("_n")


# ---------------------------------------------------------------- selections


def artifact_components(
    labels: DataFrame, confidence: float = 0.7, reject: Sequence[str] = REJECT_LABELS
) -> DataFrame:
    """Components labelled as an artifact with enough confidence; NaN keeps."""
    p = F.col("prob")
    return labels.where(F.col("label").isin(list(reject)) & ~F.isnan(p) & (p >= confidence))


def default_spectrum_channels(df: DataFrame) -> DataFrame:
    """Up to three preferred channels per session, else its first three."""
    present = df.select("session_id", "channel", "channel_idx").distinct()
    ranked = present.withColumn("_pref", rank_in(F.col("channel"), SPECTRUM_PRIORITY))
    # channels per session are bounded by the montage
    w = Window.partitionBy("session_id")
    return (
        ranked.withColumn("_any", F.max(F.col("_pref").isNotNull()).over(w))
        .where(F.col("_pref").isNotNull() | ~F.col("_any"))
        .withColumn("ord", F.row_number().over(w.orderBy(F.coalesce("_pref", "channel_idx"))))
        .where("ord <= 3")
        .select("session_id", "channel", "ord")
    )
