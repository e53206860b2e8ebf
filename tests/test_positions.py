"""Recordings that start at any index or miss samples: each gapless stretch is treated on its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from encephalake.functions.layout import gapless_stretches
from encephalake.operators import signal as C
from encephalake.operators import spectral, windows

KEYS = ["session_id", "channel_idx"]


def keyed(df, value="uv"):
    return {(r.channel_idx, r.sample_idx): r[value] for r in df.collect()}


OPERATORS = {
    "notch": (lambda s: C.notch(s, length=300), "uv"),
    "preprocess": (C.preprocess, "uv"),
    "causal notch": (lambda s: C.iir_notch(s, length=200), "uv"),
    "envelope": (lambda s: C.rms_envelope(s, length=64), "rms"),
    "phase": (C.instantaneous_phase, "b"),
    "long phase": (lambda s: C.instantaneous_phase(s, piece=10), "b"),
    "states": (lambda s: C.solve_states(s.withColumn("f", F.abs("uv") / 100), length=50, fan=4), "a"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_stretches_keep_their_indexes(to_samples, synthetic, name):
    run, value = OPERATORS[name]
    whole = to_samples(synthetic[:2, :900])
    parts = [(130, 500), (510, 511), (512, 900)]
    inside = " or ".join(f"sample_idx >= {a} and sample_idx < {b}" for a, b in parts)
    got = keyed(run(whole.where(inside)), value)
    assert sorted(i for c, i in got if c == 0) == [i for a, b in parts for i in range(a, b)]
    for a, b in parts if name != "envelope" else parts[:1]:
        alone = whole.where(f"sample_idx >= {a} and sample_idx < {b}").withColumn("sample_idx", F.col("sample_idx") - a)
        for (c, i), v in keyed(run(alone), value).items():
            if name != "envelope" or i < b - a - 6:
                turn = abs(got[c, i + a] - v)
                assert min(turn, abs(turn - 2 * np.pi) if value == "b" else turn) < 1e-6


def test_gapless_stretches(spark):
    places = [*range(3, 9), 11, 12, *range(20, 45), 46, *range(60, 61)]
    rows = spark.createDataFrame([("s", 0, i) for i in places], "session_id string, channel_idx int, sample_idx long")
    got = sorted((r.stretch, r.sample_idx) for r in gapless_stretches(rows, KEYS, length=8).collect())
    want, start = [], None
    for before, i in zip([None, *places], places):
        start = i if before is None or i != before + 1 else start
        want.append((start, i - start))
    assert got == sorted(want)


def test_spectra_and_segments_count_from_the_first_index(spark, to_samples, synthetic):
    whole = to_samples(synthetic[:2, :800])
    cropped = whole.where("sample_idx >= 125")
    moved = cropped.withColumn("sample_idx", F.col("sample_idx") - 125)
    for make in (lambda s: spectral.welch(spectral.spans_whole(s), KEYS),):
        a, b = (make(s).toPandas().sort_values(["channel_idx", "k"]).psd.to_numpy() for s in (cropped, moved))
        assert np.allclose(a, b)
    labels = spark.createDataFrame([("T0", i, i % 2) for i in range(3)], "session_id string, seg long, label int")
    a, b = (windows.equal_segments(s, labels).groupBy("channel_idx", "seg").agg(F.sum("uv").alias("x"), F.count("*").alias("n")).orderBy("channel_idx", "seg").toPandas() for s in (cropped, moved))
    assert np.allclose(a, b)


def test_clock_positions_cost_no_sections(spark):
    """Marks and samples at clock times: the per-session table is repeated for the places they hold, not from 0 on."""
    at = 4_000_000_000_000_000
    marks = spark.createDataFrame([("T0", at, 1, "a"), ("T0", at + 10**7, 2, "b")], "session_id string, sample_index bigint, marker_id int, label string")
    ends = spark.createDataFrame([("T0", at + 2 * 10**7)], "session_id string, n_samples bigint")
    spans = windows.report_windows(marks, ends).orderBy("onset_sec").collect()
    assert [(r.label, round((r.end_sec - r.onset_sec) * 125)) for r in spans] == [("a", 10**7), ("b", 10**7 - 1)]
    x = spark.range(8).select(F.lit("T0").alias("session_id"), F.lit(0).alias("channel_idx"), (F.col("id") + at).alias("sample_idx"), F.col("id").cast("double").alias("uv"))
    assert sorted(r.f for r in C.normalise(x, value="uv").collect())[::7] == [0.0, pytest.approx(1.0)]
    assert C.scale_by_session(x).count() == 8
