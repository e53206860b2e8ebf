"""Sliding windows, segments, schedules and joins of windows to states."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import MARKER_CLOSED, MARKER_OPEN, NON_STATE_LABELS, SAMPLE_RATE, values_table
from ..functions.expr import seconds
from ..functions.frames import halo_frames, over_frames
from ..functions.layout import (
    KEYS,
    SECTION,
    interval_join,
    next_in_order,
    place_join,
    running_sum,
    section_join,
)


def window_shape(window_sec: float = 2.0, overlap: float = 0.0, fs: float = SAMPLE_RATE) -> tuple[int, int]:
    """Window and hop in samples, rounding half to even."""
    if overlap < 0 or overlap >= 1:
        raise ValueError("windows can share no more than a part of their length")
    w = int(round(window_sec * fs))
    return w, max(1, int(round(w * (1.0 - overlap))))


def assign_windows(df: DataFrame, w: int, hop: int, pos: str = "sample_idx") -> DataFrame:
    """One row per (sample, window it lies in): at most ceil(w / hop) copies."""
    p = F.col(pos)
    rows = df.where(p % hop < w) if hop > w else df
    if w == hop:
        return rows.withColumn("win", F.expr(f"{pos} div {hop}"))
    first = F.greatest(F.lit(0), F.floor((p - w) / hop) + 1).cast("bigint")
    return rows.withColumn("win", F.explode(F.sequence(first, F.expr(f"{pos} div {hop}"))))


def center_sec(w: int, hop: int, fs: float = SAMPLE_RATE) -> Column:
    return (F.col("win") * hop + w / 2.0) / F.lit(float(fs))


def sliding(
    samples: DataFrame,
    w: int,
    hop: int,
    aggs: Sequence[Column],
    keys: Sequence[str] = KEYS,
    fs: float = SAMPLE_RATE,
) -> DataFrame:
    """Aggregate complete windows only; adds ``center_sec``."""
    return (
        assign_windows(samples, w, hop)
        .groupBy(*keys, "win")
        .agg(F.count(F.lit(1)).alias("n"), *aggs)
        .where(F.col("n") == w)
        .withColumn("center_sec", center_sec(w, hop, fs))
    )


def score_windows(
    samples: DataFrame,
    model: Callable[[np.ndarray, float], np.ndarray],
    window_sec: float = 2.0,
    overlap: float = 0.0,
    fs: float = SAMPLE_RATE,
) -> DataFrame:
    """Apply the caller's ``model(matrix, fs) -> vector`` to every window, inside its halo frame."""
    w, hop = window_shape(window_sec, overlap, fs)

    def apply(frame):
        rows = [(win, np.asarray(model(x, fs), dtype=float).ravel()) for win, _, x in frame.matrices()]
        yield {"win": [r[0] for r in rows], "embedding": [r[1] for r in rows]}

    out = over_frames(halo_frames(samples, w, hop), ["session_id"], w, hop, "win bigint, embedding array<double>", apply)
    return out.select("session_id", "win", center_sec(w, hop, fs).alias("center_sec"), "embedding")


# ---------------------------------------------------------------- segments


def extents(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, _from, _to): first and last index of each recording."""
    return samples.groupBy(*keys).agg(F.min("sample_idx").alias("_from"), F.max("sample_idx").alias("_to"))


def equal_segments(samples: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, ends: DataFrame | None = None) -> DataFrame:
    """Cut a recording into as many equal parts as it has labels.

    ``labels`` is (session_id, seg, label); ``ends`` are the ``extents`` of the recordings that are wanted, all if not given.  Parts are counted from the recording's
    first index; the tail that does not fill a segment is dropped.  Adds ``seg``, ``label``, ``pos`` and ``seg_len``.
    """
    counts = labels.groupBy("session_id").agg(F.count(F.lit(1)).alias("_k"))
    lengths = (extents(samples, keys) if ends is None else ends).withColumn("_n", F.col("_to") - F.col("_from") + 1)
    shape = (
        lengths.join(counts, "session_id")
        .withColumn("seg_len", F.expr("_n div _k"))
        .where("seg_len > 0")
        .select(*keys, "seg_len", "_k", "_from", "_to")
    )
    cut = (
        section_join(samples, shape, keys, "_to", first="_from")
        .withColumn("seg", F.expr("(sample_idx - _from) div seg_len"))
        .where("seg < _k")
        .withColumn("pos", F.expr("(sample_idx - _from) % seg_len"))
        .drop("_k", "_from", "_to")
    )
    # a segment may be half of a recording: its label is repeated once per section of it
    longest = shape.groupBy("session_id").agg(F.max("seg_len").alias("_len"))
    sections = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"_len div {SECTION}"))).alias("_sec")
    spread = labels.select("session_id", "seg", "label").join(longest, "session_id").select("session_id", "seg", "label", sections)
    return cut.withColumn("_sec", F.expr(f"pos div {SECTION}")).join(spread, ["session_id", "seg", "_sec"]).drop("_sec")


def recording_ends(samples: DataFrame) -> DataFrame:
    return samples.groupBy("session_id").agg((F.max("sample_idx") + 1).alias("n_samples"))


def state_intervals(
    markers: DataFrame,
    ends: DataFrame,
    skip: Sequence[str] = NON_STATE_LABELS,
    fs: float = SAMPLE_RATE,
) -> DataFrame:
    """(session, onset_sec, end_sec, label): a marker's state runs to the next marker.

    The last one runs to the last sample's time.  Session bounds are no states
    but still end the state before them.
    """
    held = place_join(markers, ends, ["session_id"], "sample_index")
    rows = next_in_order(held, ["session_id"], "sample_index", ["sample_index"])
    last = (F.col("n_samples") - 1) / F.lit(float(fs))
    return rows.where(~F.col("label").isin(list(skip))).select(
        "session_id",
        seconds(F.col("sample_index"), fs).alias("onset_sec"),
        F.coalesce(F.col("next_sample_index") / F.lit(float(fs)), last).alias("end_sec"),
        "label",
        "marker_id",
    )


def assign_states(
    windows: DataFrame, intervals: DataFrame, labels: Sequence[str] | None = None, width_sec: float = 32.0
) -> DataFrame:
    """Windows whose centre lies in [onset, end) get the state's label; others go."""
    if labels is not None:
        intervals = intervals.where(F.col("label").isin(list(labels)))
    states = intervals.select("session_id", "onset_sec", "end_sec", "label")
    inside = (F.col("center_sec") >= F.col("onset_sec")) & (F.col("center_sec") < F.col("end_sec"))
    joined = interval_join(
        windows, states, ["session_id"], "center_sec", "onset_sec", "end_sec", inside, width_sec
    )
    return joined.drop("onset_sec", "end_sec")


def merge_states(windows: DataFrame, groups: dict[str, Sequence[str]], label: str = "label") -> DataFrame:
    """Replace member labels by their group's; a label may be in several groups."""
    rows = [(g, member) for g, members in groups.items() for member in members]
    mapping = values_table(windows.sparkSession, ["state_group", label], rows)
    return windows.join(F.broadcast(mapping), label)


def marker_segments(
    markers: DataFrame,
    ends: DataFrame,
    open_id: int = MARKER_OPEN,
    closed_id: int = MARKER_CLOSED,
    closed_name: str = "eyes_closed",
) -> DataFrame:
    """[start, end) per named phase, in samples; a repeated name keeps its last segment."""
    held = place_join(markers, ends, ["session_id"], "sample_index")
    rows = next_in_order(held, ["session_id"], "sample_index", ["sample_index"])
    name = F.when(F.col("marker_id") == open_id, F.col("label")).when(
        F.col("marker_id") == closed_id, F.lit(closed_name)
    )
    bounds = F.struct(
        F.col("sample_index").alias("start_idx"),
        F.coalesce("next_sample_index", "n_samples").alias("end_idx"),
    )
    return (
        rows.withColumn("segment", name)
        .where(F.col("segment").isNotNull())
        .groupBy("session_id", "segment")
        .agg(F.max_by(bounds, "sample_index").alias("b"))
        .select("session_id", "segment", "b.start_idx", "b.end_idx")
    )


def cut_segments(samples: DataFrame, segments: DataFrame, width: int = 4096) -> DataFrame:
    """Samples inside [start_idx, end_idx) of each segment, with ``pos`` and ``seg_len``."""
    inside = (F.col("sample_idx") >= F.col("start_idx")) & (F.col("sample_idx") < F.col("end_idx"))
    joined = interval_join(
        samples, segments, ["session_id"], "sample_idx", "start_idx", "end_idx", inside, float(width)
    )
    return (
        joined.withColumn("pos", F.col("sample_idx") - F.col("start_idx"))
        .withColumn("seg_len", F.col("end_idx") - F.col("start_idx"))
        .drop("start_idx", "end_idx")
    )


def report_windows(
    markers: DataFrame,
    ends: DataFrame,
    min_sec: float = 4.0,
    skip: Sequence[str] = NON_STATE_LABELS,
    fs: float = SAMPLE_RATE,
) -> DataFrame:
    """Intervals between kept markers of at least ``min_sec``; skipped labels do not end one."""
    kept = markers.where(~F.col("label").isin(list(skip)))
    spans = state_intervals(kept, ends, skip=["\0"], fs=fs)
    return spans.where(F.col("end_sec") - F.col("onset_sec") >= min_sec)


# ---------------------------------------------------------------- schedules


def block_schedule(sessions: DataFrame, blocks: Sequence[tuple[str, int, float]]) -> DataFrame:
    """Repeat the blocks for ``n_cycles`` (a column of ``sessions``) per session."""
    cycle_sec = float(sum(b[2] for b in blocks))
    starts = np.concatenate([[0.0], np.cumsum([b[2] for b in blocks])[:-1]])
    phases = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(condition).alias("condition"),
                F.lit(float(sec)).alias("duration_sec"),
                F.lit(float(at)).alias("offset_sec"),
            )
            for (label, condition, sec), at in zip(blocks, starts)
        ]
    )
    return (
        sessions.where("n_cycles > 0")
        .withColumn("cycle", F.explode(F.sequence(F.lit(1), F.col("n_cycles").cast("int"))))
        .withColumn("p", F.explode(phases))
        .select(
            "session_id",
            ((F.col("cycle") - 1) * F.lit(cycle_sec) + F.col("p.offset_sec")).alias("start_sec"),
            "p.duration_sec",
            "p.condition",
            "p.label",
            "cycle",
        )
    )


def cycles_for(samples: DataFrame, blocks: Sequence[tuple[str, int, float]], fs: float = SAMPLE_RATE) -> DataFrame:
    """How many cycles of a protocol cover each recording."""
    cycle = float(sum(b[2] for b in blocks))
    return recording_ends(samples).select(
        "session_id", F.ceil(F.col("n_samples") / F.lit(fs * cycle)).cast("int").alias("n_cycles")
    )


def label_by_schedule(segments: DataFrame, schedule: DataFrame, width_sec: float = 600.0) -> DataFrame:
    """``condition`` of the first block that contains [start_sec, end_sec], else -1."""
    blocks = schedule.select(
        "session_id",
        F.col("start_sec").alias("_s"),
        (F.col("start_sec") + F.col("duration_sec")).alias("_e"),
        F.col("condition").alias("_c"),
    )
    held = (F.col("start_sec") >= F.col("_s")) & (F.col("end_sec") <= F.col("_e"))
    cols = segments.columns
    joined = interval_join(segments, blocks, ["session_id"], "start_sec", "_s", "_e", held, width_sec, "left")
    return (
        joined.groupBy(*cols)
        .agg(F.min_by("_c", "_s").alias("_c"))
        .withColumn("condition", F.coalesce("_c", F.lit(-1)))
        .drop("_c")
    )


def protocol_timeline(
    phases: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column]
) -> DataFrame:
    """(keys, t_sec, code, text) events of phases laid end to end.

    ``phases`` has start_code, start_text, end_code, end_text, duration_sec; an
    end event is written only where end_code is set.
    """
    total = running_sum(phases, keys, bucket, order, "duration_sec")
    begin = F.struct(
        (F.col("running") - F.col("duration_sec")).alias("t_sec"),
        F.col("start_code").alias("code"),
        F.col("start_text").alias("text"),
    )
    finish = F.when(
        F.col("end_code").isNotNull(),
        F.struct(
            F.col("running").alias("t_sec"), F.col("end_code").alias("code"), F.col("end_text").alias("text")
        ),
    )
    return total.select(*keys, F.explode(F.array_compact(F.array(begin, finish))).alias("ev")).select(
        *keys, "ev.t_sec", "ev.code", "ev.text"
    )


def trial_onsets(
    trials: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    isi: str = "isi_sec",
    fs: float = SAMPLE_RATE,
) -> DataFrame:
    """Onset sample of each trial: the running interval, truncated to a sample.

    The product is rounded to 1e-6 first so that truncation does not depend on
    the order of the float additions.
    """
    total = running_sum(trials, keys, bucket, order, isi)
    return total.withColumn("onset_sample", F.floor(F.round(F.col("running") * fs, 6)).cast("bigint")).drop(
        "running"
    )


def trial_totals(trials: DataFrame, keys: Sequence[str], isi: str = "isi_sec") -> DataFrame:
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"), F.sum(isi).alias("duration_sec"), F.avg(isi).alias("mean_isi")
    )


def midpoint_rows(pn: DataFrame, segments: DataFrame) -> DataFrame:
    """Values at the middle of each segment, index clipped to the last sample.

    ``segments`` is (session_id, seg, start_idx, seg_len).
    """
    ends = pn.groupBy("session_id").agg(F.max("sample_idx").alias("_last"))
    mids = place_join(segments, ends, ["session_id"], "start_idx").select(
        "session_id",
        "seg",
        F.least(F.expr("start_idx + seg_len div 2"), F.col("_last")).alias("sample_idx"),
    )
    return pn.join(mids, ["session_id", "sample_idx"])
