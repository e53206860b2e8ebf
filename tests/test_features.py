import numpy as np
import pytest
from pyspark.sql import functions as F

from encephalake.dims import CHANNEL_NAMES
from encephalake.operators import features as E
from encephalake.operators import project as P
from encephalake.operators import response as R
from encephalake.operators import spectral as D

KEYS = ["session_id", "channel_idx", "win"]
T = np.arange(500) / 125


def spans(samples, w=500):
    return D.spans_from_windows(samples, w, w)


def test_feature_count_and_names(to_samples):
    m = np.random.default_rng(0).normal(0, 50, size=(4, 500))
    rows = E.feature_rows(spans(to_samples(m)), ["session_id", "win"], names=CHANNEL_NAMES).toPandas()
    assert len(rows) == 4 * 25 + 6 and rows["name"].is_unique
    assert np.isfinite(rows["value"]).all()
    assert {"Fp1_alpha_power", "Fp2_delta_theta_ratio", "F3_hjorth_mobility", "coh_Fp1_F4"} <= set(rows["name"])
    vec = E.feature_vectors(E.feature_rows(spans(to_samples(m)), ["session_id", "win"], names=CHANNEL_NAMES), ["session_id", "win"])
    r = vec.first()
    assert len(r["names"]) == len(r["values"]) == 106


def test_hjorth_of_a_flat_channel_is_zero(to_samples):
    r = E.waveform_features(spans(to_samples(np.ones((1, 500)))), KEYS).first()
    assert r.hjorth_activity == 0 and r.hjorth_mobility == 0 and r.hjorth_complexity == 0
    assert r.line_length == 0 and r.zero_crossings == 0


def test_entropy_of_noise_and_sine(to_samples):
    m = np.stack([np.random.default_rng(0).normal(size=500), np.sin(2 * np.pi * 10 * T)])
    psd = D.welch(spans(to_samples(m)), KEYS)
    e = {r.channel_idx: r.spectral_entropy for r in E.spectral_entropy(psd, KEYS).collect()}
    assert e[0] > 0.7 > e[1]


def test_multi_segment_coherence_equals_numpy(to_samples):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(3, 2000))
    m[1] += m[0]
    got = {(r.ch_i, r.ch_j): r.coherence for r in D.coherence(D.spans_whole(to_samples(m)), ["session_id"], segs_per_row=4).collect()}
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(250) / 250)
    z = [np.stack([np.fft.rfft((x[s : s + 250] - x[s : s + 250].mean()) * w) for s in range(0, 1751, 125)]) for x in m]
    f = np.arange(126) * 0.5
    band = (f >= 8) & (f < 13)
    for (i, j), v in got.items():
        xy = (np.conj(z[i]) * z[j]).mean(axis=0)
        c = np.abs(xy) ** 2 / ((np.abs(z[i]) ** 2).mean(axis=0) * (np.abs(z[j]) ** 2).mean(axis=0))
        assert v == pytest.approx(c[band].mean(), abs=1e-12)
    assert len(got) == 3


def test_single_segment_coherence_is_one_and_one_channel_gets_half(to_samples):
    m = np.random.default_rng(2).normal(size=(3, 250))
    out = D.encode_sliding(to_samples(m), step_sec=2.0).collect()
    assert all(r.b == pytest.approx(2 * np.pi) for r in out)
    out = D.encode_sliding(to_samples(m[:1]), step_sec=2.0).collect()
    assert out[0].b == pytest.approx(np.pi)
    # shorter coherence segments are informative
    out = D.encode_sliding(to_samples(m), step_sec=2.0, coherence_nperseg=64).collect()
    assert all(0 < r.b < 2 * np.pi for r in out)


def test_reference_channel_restricts_pairs(to_samples):
    m = np.random.default_rng(3).normal(size=(4, 1000))
    pairs = D.coherence(D.spans_whole(to_samples(m)), ["session_id"]).toPandas()
    want = pairs[(pairs.ch_i == 2) | (pairs.ch_j == 2)]["coherence"].mean()
    got = D.encode_multichannel(D.spans_whole(to_samples(m)), ["session_id"], reference=2).first()
    assert got.b == pytest.approx(2 * np.pi * want)


def test_injected_alpha_ranks_highest(to_samples):
    m = np.random.default_rng(4).normal(0, 5, size=(16, 2000))
    m[12:] += 15 * np.sin(2 * np.pi * 10 * np.arange(2000) / 125)
    psd = D.welch(D.spans_whole(to_samples(m)), ["session_id", "channel_idx"], overlap=0.0, taper="hamming")
    power = D.band_mean(psd, ["session_id", "channel_idx"], 8, 12).toPandas().sort_values("band_power")
    assert set(power["channel_idx"].tail(4)) == {12, 13, 14, 15}
    empty = D.band_mean(psd, ["session_id", "channel_idx"], 8.1, 8.2).first()
    assert empty.band_power == 0.0


def test_spectrum_channels_fall_back_to_the_first_three(spark):
    df = spark.createDataFrame([("a", c, i) for i, c in enumerate("ABCD")], "session_id string, channel string, channel_idx int")
    assert {r.channel for r in P.default_spectrum_channels(df).collect()} == {"A", "B", "C"}


def test_alpha_response_passes_on_a_real_increase(spark, to_samples):
    rng = np.random.default_rng(5)
    t = np.arange(5000) / 125
    m = rng.normal(0, 5, size=(16, 5000)) + np.where((np.arange(5000) // 1250) % 2 == 1, 20, 2) * np.sin(2 * np.pi * 10 * t)
    labels = spark.createDataFrame([("T0", i, i % 2) for i in range(4)], "session_id string, seg bigint, label int")
    rows = R.alpha_response(to_samples(m), labels).collect()
    assert {r.channel for r in rows} == {"O1", "O2", "P3", "P4"} and all(r.passed for r in rows)


def test_latest_and_chunks(to_samples):
    m = np.arange(600.0)[None, :]
    assert P.latest(to_samples(m), 10).agg(F.min("uv")).first()[0] == 590
    assert P.latest(to_samples(m[:, :5]), 10).count() == 5
    assert P.full_chunks(to_samples(m)).count() == 2


def test_errors(to_samples):
    with pytest.raises(ValueError):
        P.relabel(to_samples(np.ones((1, 5))), "no-such-version")
    with pytest.raises(Exception, match="out of range"):
        to_samples(np.ones((1, 5))).select(P.board_of(F.lit(17))).collect()


def test_unreliable_components_are_kept(spark):
    rows = [(0, "brain", 0.95), (1, "eye blink", 0.85), (2, "muscle artifact", 0.5), (3, "brain", 0.9), (4, "line noise", 0.99), (5, "eye blink", float("nan"))]
    df = spark.createDataFrame(rows, "component int, label string, prob double")
    assert [r.component for r in P.artifact_components(df).orderBy("component").collect()] == [1, 4]
    assert [r.component for r in P.artifact_components(df, 0.5).orderBy("component").collect()] == [1, 2, 4]


def test_spectra_of_a_batch_need_few_copies_of_it():
    """A full Arrow batch of 2 s windows is worked on in slices, with the results of the whole."""
    import tracemalloc

    import pandas as pd

    from encephalake.functions import kernels
    from encephalake.operators import spectral

    rows = list(np.random.default_rng(0).normal(size=(8000, 250))) + [np.ones(20)]
    x = pd.Series(rows)
    tracemalloc.start()
    got = spectral._batched(x, lambda m: kernels.density(m, 125.0, "hann"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 8001 and len(got[8000]) == 11
    np.testing.assert_allclose(np.stack(got[:8000].to_list()), kernels.density(np.stack(rows[:8000]), 125.0, "hann"), rtol=1e-12)
    assert peak < 8000 * 250 * 8
