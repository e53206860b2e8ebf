"""Signal-quality metrics, grading and the tables behind the quality charts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import BENCH, GRADE_LIMITS, RAIL_UV, SAMPLE_RATE, SUSPICIOUS
from ..functions import kernels
from ..functions.frames import halo_frames, over_frames
from ..functions.layout import KEYS, own, spread_join, with_halo
from ..functions.quantiles import exact_quantiles, exact_quantiles_of

GREEN, YELLOW, RED = 0, 1, 2


def railed_pct(x: Column, mean: Column, threshold: Column | float) -> Column:
    """Aggregate: percent of samples farther than ``threshold`` from the mean."""
    return F.coalesce(F.avg((F.abs(x - mean) > threshold).cast("double")) * 100.0, F.lit(0.0))


def rail_table(spans: DataFrame, keys: Sequence[str], threshold: float = RAIL_UV[BENCH]) -> DataFrame:
    """Railed percent per bounded span; mean and count share the span's shuffle."""
    w = Window.partitionBy(*keys)
    return (
        spans.withColumn("_m", F.avg("uv").over(w))
        .groupBy(*keys)
        .agg(railed_pct(F.col("uv"), F.col("_m"), threshold).alias("rail_pct"))
    )


def std_table(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spans.groupBy(*keys).agg(F.stddev_pop("uv").alias("std_uv"))


def metrics_of(m: np.ndarray, threshold: float, fs: float = SAMPLE_RATE, freq: float = 60.0) -> np.ndarray:
    """Railed percent, std and line ratio of equally long windows, one row each.

    The notch of a window starts from rest, so its output is the window times a
    fixed lower-triangular matrix of the impulse response.
    """
    notch = kernels.notch_matrix(freq, 30.0, fs, m.shape[1])
    std = m.std(axis=1)
    railed = (np.abs(m - m.mean(axis=1, keepdims=True)) > threshold).mean(axis=1) * 100.0
    return np.stack([railed, std, np.clip(1.0 - ((m @ notch.T).std(axis=1) / (std + 1e-9)) ** 2, 0.0, 1.0)], axis=1)


def quality_metrics(x: Column, threshold: float, fs: float = SAMPLE_RATE, freq: float = 60.0) -> Column:
    """rail_pct, std_uv and line_ratio of window arrays, as one struct column."""

    @F.pandas_udf("struct<rail_pct:double,std_uv:double,line_ratio:double>")
    def run(v: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(v), 3))
        lengths = v.map(len).to_numpy()
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            out[at] = metrics_of(np.stack(v.iloc[at].to_list()), threshold, fs, freq)
        return pd.DataFrame(out, columns=["rail_pct", "std_uv", "line_ratio"])

    return run(x)


def status(metrics: dict[str, Column], profile: str, quiet: bool = True) -> Column:
    """The worst grade that any limit of the profile gives; ``quiet`` adds the suspicious-signal rule."""
    reached = {"from": lambda x, v: x >= v, "above": lambda x, v: x > v, "below": lambda x, v: x < v}
    grades = [
        F.when(reached[side](metrics[name], limit), grade)
        for (name, side), limits in GRADE_LIMITS[profile].items()
        for grade, limit in zip((YELLOW, RED), limits)
    ]
    if quiet:
        std, line, rail = SUSPICIOUS[profile]
        grades.append(F.when((metrics["std"] > std) & (metrics["line"] < line) & (metrics["rail"] < rail), YELLOW))
    return F.greatest(F.lit(GREEN), *grades)


def _metrics() -> dict[str, Column]:
    return {"rail": F.col("rail_pct"), "std": F.col("std_uv"), "line": F.col("line_ratio")}


def grade(df: DataFrame, profile: str = BENCH, quiet: bool = True) -> DataFrame:
    return df.withColumn("status", status(_metrics(), profile, quiet).cast("int"))


def grade_all_profiles(df: DataFrame) -> DataFrame:
    """One graded row per profile."""
    graded = F.array(*[F.struct(F.lit(p).alias("profile"), status(_metrics(), p).cast("int").alias("status")) for p in GRADE_LIMITS])
    return df.select("*", F.inline(graded))


def sliding_quality(
    samples: DataFrame, window_sec: float = 2.0, step_sec: float = 1.0, profile: str = BENCH,
    fs: float = SAMPLE_RATE, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Metrics and status of each channel over sliding windows, cut out of the channel's halo frames."""
    w, hop = int(window_sec * fs), int(step_sec * fs)
    threshold = RAIL_UV[profile]

    def measure(frame):
        for wins, x, held in frame.slabs():
            whole = held[:, 0].all(axis=1)
            rail, std, line = metrics_of(x[whole, 0], threshold, fs).T if whole.any() else np.zeros((3, 0))
            yield {"win": wins[whole], "rail_pct": rail, "std_uv": std, "line_ratio": line}

    frames = halo_frames(samples, w, hop, keys, channel=None)
    rows = over_frames(frames, keys, w, hop, "win bigint, rail_pct double, std_uv double, line_ratio double", measure)
    return grade(rows, profile)


def board_check(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """OK / FLAT / NOISY by channel std; a std of exactly 1 is NOISY."""
    s = F.col("std_uv")
    return std_table(samples, keys).withColumn(
        "check", F.when((s > 1) & (s < 500), "OK").when(s < 1, "FLAT").otherwise("NOISY")
    )


# ---------------------------------------------------------------- log analysis
# log rows: (session_id, t, channel, channel_idx, rail_pct, std_uv, line_ratio, status)


def channel_summary(log: DataFrame, keys: Sequence[str] = ("session_id", "channel")) -> DataFrame:
    """Share of time per status, exact medians and the best std of each channel."""
    keys = list(keys)
    s = F.col("status")
    shares = log.groupBy(*keys).agg(
        (F.avg((s == GREEN).cast("double")) * 100).alias("pct_green"),
        (F.avg((s == YELLOW).cast("double")) * 100).alias("pct_yellow"),
        (F.avg((s == RED).cast("double")) * 100).alias("pct_red"),
        F.coalesce(F.min(F.when(F.col("std_uv") > 1, F.col("std_uv"))), F.lit(0.0)).alias("min_std"),
    )
    medians = exact_quantiles_of(
        log, keys, {"med_std": ("std_uv", 0.5), "med_line": ("line_ratio", 0.5), "med_rail": ("rail_pct", 0.5)}
    )
    return shares.join(medians, keys).withColumn("med_line", F.col("med_line") * 100)


def std_correlation(log: DataFrame, clip: float = 2000.0) -> DataFrame:
    """Pearson correlation of clipped std between channels of a session.

    The channels of one time point (montage size) meet in a row; pairs come from
    that row and are combined by a partial aggregate.
    """
    at_t = log.groupBy("session_id", "t").agg(
        F.array_sort(
            F.collect_list(F.struct("channel_idx", F.least(F.col("std_uv"), F.lit(clip)).alias("v")))
        ).alias("g")
    )
    pairs = F.flatten(
        F.transform(
            "g",
            lambda a: F.transform(
                F.filter("g", lambda b: b["channel_idx"] > a["channel_idx"]),
                lambda b: F.struct(
                    a["channel_idx"].alias("ch_i"), b["channel_idx"].alias("ch_j"),
                    a["v"].alias("x"), b["v"].alias("y"),
                ),
            ),
        )
    )
    rows = at_t.select("session_id", F.explode(pairs).alias("p")).select("session_id", "p.*")
    return rows.groupBy("session_id", "ch_i", "ch_j").agg(F.corr("x", "y").alias("corr"))


def contact_changes(log: DataFrame, order: str = "step", clip: float = 2000.0, q: float = 0.9) -> DataFrame:
    """Times at which the summed change of std exceeds the session's 90th percentile.

    ``order`` numbers the time points of a session; the lag reaches one step back
    through a halo, and the percentile is exact.
    """
    rows = with_halo(log, 4096, 1, 0, pos=order)
    w = Window.partitionBy("session_id", "channel_idx", "chunk").orderBy(order)
    v = F.least(F.col("std_uv"), F.lit(clip))
    moved = (
        rows.withColumn("d", F.abs(v - F.lag(v).over(w)))
        .where(own(4096, order))
        .groupBy("session_id", order, "t")
        .agg(F.sum("d").alias("total_change"))
        .where(F.col("total_change").isNotNull())
    )
    limit = exact_quantiles(moved, ["session_id"], "total_change", {"limit": q})
    return (
        spread_join(moved, limit, ["session_id"], F.col(order))
        .where("total_change > limit")
        .select("session_id", "t", "total_change")
    )


def board_comparison(log: DataFrame, clip: float = 2000.0) -> DataFrame:
    """Median and quartiles over the channels of each board at every time point."""
    board = F.when(F.col("channel_idx") < 8, F.lit("main")).otherwise(F.lit("extension"))
    values = {
        "std": F.least(F.col("std_uv"), F.lit(clip)),
        "line": F.col("line_ratio") * 100,
        "rail": F.col("rail_pct"),
    }
    # a board has eight channels, so these percentiles are over eight values
    aggs = [
        F.percentile(v, F.lit(p)).alias(f"{n}_{tag}")
        for n, v in values.items()
        for tag, p in (("med", 0.5), ("q25", 0.25), ("q75", 0.75))
    ]
    return log.withColumn("board", board).groupBy("session_id", "t", "board").agg(*aggs)


def metric_grid(log: DataFrame, channels: Sequence[str], metric: str = "std_uv", clip: float | None = 2000.0) -> DataFrame:
    """Channel x time table: one column per channel (a fixed list, so no extra job)."""
    v = F.col(metric) if clip is None else F.least(F.col(metric), F.lit(clip))
    return log.groupBy("session_id", "t").pivot("channel", list(channels)).agg(F.first(v))


def rms_light(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root mean square of a span: green 1-30 uV, red below .5 or above 100, else yellow."""
    r = F.sqrt(F.avg(F.col("uv") * F.col("uv")))
    v = F.col("rms")
    light = F.when((v < 0.5) | (v > 100), RED).when((v >= 1) & (v <= 30), GREEN).otherwise(YELLOW)
    return spans.groupBy(*keys).agg(r.alias("rms")).withColumn("light", light)


def single_bin_amplitude(
    spans: DataFrame, keys: Sequence[str], freq: float = 31.25, drive_na: float = 6.0, fs: float = SAMPLE_RATE
) -> DataFrame:
    """Amplitude at one frequency over a span and the impedance it implies (kOhm)."""
    w = 2 * np.pi * freq / fs
    re = F.sum(F.col("uv") * F.cos(w * F.col("pos")))
    im = F.sum(F.col("uv") * F.sin(w * F.col("pos")))
    amp = 2 * F.sqrt(re * re + im * im) / F.count(F.lit(1))
    return (
        spans.groupBy(*keys)
        .agg(amp.alias("amplitude_uv"))
        .withColumn("impedance_kohm", F.col("amplitude_uv") / F.lit(drive_na))
    )
