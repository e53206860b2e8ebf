"""Halo frames against windows cut plainly."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import long_frame
from pyspark.sql import Window
from pyspark.sql import functions as F

from encephalake.dims import CHANNEL_NAMES
from encephalake.functions import frames, kernels
from encephalake.operators import features as E
from encephalake.operators import quality as Q
from encephalake.operators import spectral as D
from encephalake.operators import windows as W

KEYS = ["session_id", "channel_idx", "win"]


def plain_windows(samples, w, hop):
    """(window, channel) -> values, of the windows that miss no sample."""
    found = {}
    for c, g in samples.groupby("channel_idx"):
        at = dict(zip(g["sample_idx"], g["uv"]))
        for win in range(max(at) // hop + 1):
            if all(win * hop + i in at for i in range(w)):
                found[win, c] = np.array([at[win * hop + i] for i in range(w)])
    return found


@pytest.fixture()
def holed(spark):
    """Three channels from index 37 on; one misses some samples, one ends early, one sample is there twice."""
    pdf = long_frame(np.random.default_rng(6).normal(size=(3, 1200)))
    pdf["sample_idx"] += 37
    hole = (pdf["channel_idx"] == 1) & pdf["sample_idx"].between(400, 420) | (pdf["channel_idx"] == 2) & (pdf["sample_idx"] > 900)
    return pdf[~hole], spark.createDataFrame(pdf[~hole])


@pytest.mark.parametrize("w, hop, length", [(100, 30, 64), (100, 30, 2048), (50, 50, 64), (40, 90, 100), (250, 1, 300), (300, 7, 10)])
def test_frames_hold_every_window(holed, monkeypatch, w, hop, length):
    monkeypatch.setattr(frames, "FRAME", length)
    pdf, df = holed

    def whole(frame):
        for wins, x, held in frame.slabs():
            at, ch = np.nonzero(held.all(axis=2))
            yield {"win": wins[at], "channel_idx": frame.channels[ch], "x": list(x[at, ch])}

    rows = frames.over_frames(frames.halo_frames(df, w, hop), ["session_id"], w, hop, "win bigint, channel_idx int, x array<double>", whole).collect()
    want = plain_windows(pdf, w, hop)
    assert len(rows) == len(want) == len({(r.win, r.channel_idx) for r in rows})
    for r in rows:
        np.testing.assert_array_equal(r.x, want[r.win, r.channel_idx])


def test_one_exchange(holed):
    _, df = holed
    for out in (D.encode_sliding(df), E.window_features(df, 250, 125, CHANNEL_NAMES), Q.sliding_quality(df), W.score_windows(df, lambda x, fs: x.mean(axis=1))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_sample_there_twice_spoils_its_windows(spark):
    pdf = long_frame(np.ones((1, 300)))
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame(pdf[pdf.sample_idx == 120]))
    assert sorted(r.win for r in W.score_windows(df, lambda x, fs: x.sum(axis=1), 0.8).collect()) == [0, 2]


def test_encoding_equals_the_spans_form(holed):
    _, df = holed
    w, hop = 250, 62
    got = {(r.win, r.channel_idx): (r.a, r.b, r.c) for r in D.encode_sliding(df, coherence_nperseg=64).collect()}
    full = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    spans = D.spans_from_windows(df, w, hop).withColumn("n", full).where(F.col("n") == w)
    want = D.encode_multichannel(spans, ["session_id", "win"], nperseg=w, averaged=False, coherence_nperseg=64).collect()
    assert len(got) == len(want) > 20
    for r in want:
        assert got[r.win, r.channel_idx] == pytest.approx((r.a, r.b, r.c))


def test_features_equal_the_spans_form(to_samples):
    m = np.random.default_rng(7).normal(0, 30, size=(3, 1000))
    m[2, 250:500] = 4.0  # a flat window
    df = to_samples(m)
    named = df.withColumnRenamed("channel", "name")
    got = {(r.win, r.name): r.value for r in E.window_features(df, 250, 250, CHANNEL_NAMES, coherence_nperseg=100).collect()}
    spans = D.spans_from_windows(named, 250, 250).withColumnRenamed("name", "channel")
    want = E.feature_rows(spans, ["session_id", "win"], names=CHANNEL_NAMES, averaged=False, coherence_nperseg=100).collect()
    assert len(got) == len(want) == 4 * (3 * 25 + 3)
    for r in want:
        assert (got[r.win, r.name] is None) == (r.value is None) and got[r.win, r.name] == (r.value if r.value is None else pytest.approx(r.value, abs=1e-6)), r


def test_gap_of_a_channel_leaves_the_others(holed):
    pdf, df = holed
    got = {r.win: list(r.embedding) for r in W.score_windows(df, lambda x, fs: x.sum(axis=1), 0.8, 0.5).collect()}
    whole = plain_windows(pdf, 100, 50)
    present = {}
    for c, g in pdf.groupby("channel_idx"):
        for win in {i // 50 - k for i in g["sample_idx"] for k in (0, 1)}:
            present.setdefault(win, set()).add(c)
    want = {win: [whole[win, c].sum() for c in sorted(cs)] for win, cs in present.items() if win >= 0 and all((win, c) in whole for c in cs)}
    assert set(got) == set(want)
    for win in got:
        assert got[win] == pytest.approx(want[win])


def test_kernel_coherence_of_equal_signals_is_one():
    x = np.random.default_rng(0).normal(size=(1, 1, 400))
    both = np.concatenate([x, 3 * x], axis=1)
    i, j, value, count = kernels.window_coherence(both, np.ones_like(both, bool), 8, 13, 100, 125.0)
    assert value[0, 0] == pytest.approx(1) and count[0, 0] == 7 and (i[0], j[0]) == (0, 1)
