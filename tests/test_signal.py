import numpy as np
import pytest
from conftest import matrix_of

from encephalake.functions import kernels
from encephalake.operators import signal as C

FS = 125.0


def gain_db(taps, freq):
    return 20 * np.log10(abs(np.sum(taps * np.exp(-2j * np.pi * freq / FS * np.arange(len(taps))))))


def test_bandpass_response():
    taps = C.bandpass_stage()
    assert len(taps) == 825
    for f in (0.5, 10.0, 50.0):
        assert gain_db(taps, f) > -1
    for f in (0.25, 56.25):
        assert gain_db(taps, f) == pytest.approx(-6, abs=0.2)
    # 60 Hz lies inside the upper transition: the pass band alone does not remove it
    assert gain_db(taps, 60.0) < -20
    assert gain_db(taps, 60.0) + gain_db(C.notch_stage(), 60.0) < -30
    assert gain_db(C.bandpass_stage(per_edge=False), 60.0) < -70


def test_bandpass_upper_edge_is_capped():
    np.testing.assert_allclose(C.bandpass_stage(high=80.0), C.bandpass_stage(high=61.5))


def test_notch_response():
    taps = C.notch_stage()
    assert gain_db(taps, 60.0) < -30
    assert abs(gain_db(taps, 50.0)) < 0.1 and abs(gain_db(taps, 10.0)) < 0.1


def test_iir_response_is_that_of_the_forward_backward_filter():
    taps = C.bandpass_stage(method="iir")
    assert abs(gain_db(taps, 10.0)) < 0.01
    assert gain_db(taps, 50.0) == pytest.approx(-6, abs=0.1)
    assert gain_db(taps, 0.5) == pytest.approx(-6, abs=0.1)


def test_unknown_method_is_refused():
    with pytest.raises(ValueError):
        C.bandpass_stage(method="magic")


def reference_fir(x, taps):
    half = (len(taps) - 1) // 2
    return np.convolve(kernels.odd_reflect(x, half, half), taps, "valid")


@pytest.mark.parametrize("length", [900, 8192])
def test_chunked_filter_chain_equals_whole(to_samples, length):
    m = np.random.default_rng(1).normal(size=(2, 4000)).cumsum(axis=1)
    got = matrix_of(C.preprocess(to_samples(m), length=length))
    want = [reference_fir(reference_fir(x, C.notch_stage()), C.bandpass_stage()) for x in m]
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_filter_of_a_recording_shorter_than_the_halo(to_samples):
    m = np.random.default_rng(2).normal(size=(1, 100))
    got = matrix_of(C.bandpass(to_samples(m)))
    np.testing.assert_allclose(got[0], reference_fir(m[0], C.bandpass_stage()), atol=1e-9)


def direct_form(x, b, a):
    y, z1, z2 = [], 0.0, 0.0
    for v in x:
        o = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * o + z2, b[2] * v - a[2] * o
        y.append(o)
    return np.array(y)


def test_causal_notch_equals_recurrence(to_samples):
    m = np.random.default_rng(3).normal(size=(2, 3000))
    got = matrix_of(C.iir_notch(to_samples(m), length=1000))
    b, a = kernels.notch_biquad(60.0, 30.0, FS)
    np.testing.assert_allclose(got, [direct_form(x, b, a) for x in m], atol=1e-12)


def test_rms_envelope_equals_convolution_across_chunks(to_samples, synthetic):
    got = matrix_of(C.rms_envelope(to_samples(synthetic[:3]), length=64), "rms")
    want = [np.sqrt(np.convolve(x**2, np.ones(12) / 12, "same")) for x in synthetic[:3]]
    np.testing.assert_allclose(got, want, atol=1e-9)


def solve(f, rk4=False):
    dt, a, c = 1 / FS, [0.5], [0.5]
    da = lambda y, v: -0.1 * y + v * (1 - y)
    dc = lambda y, v: 0.05 * y + v * (1 - y)
    for f0, f1 in zip(f[:-1], f[1:]):
        for s, d in ((a, da), (c, dc)):
            y = s[-1]
            if rk4:
                fm = (f0 + f1) / 2
                k1 = d(y, f0)
                k2 = d(y + dt / 2 * k1, fm)
                k3 = d(y + dt / 2 * k2, fm)
                s.append(y + dt / 6 * (k1 + 2 * k2 + 2 * k3 + d(y + dt * k3, f1)))
            else:
                s.append(y + dt * d(y, f0))
    return np.clip(a, 0, 1), np.clip(c, 0, 1)


@pytest.mark.parametrize("solver", ["euler", "rk4"])
def test_states_equal_sequential_solution(to_samples, synthetic, solver):
    drive = C.normalise(C.rms_envelope(to_samples(synthetic[:2])))
    # chunks of 32 and groups of 8 exercise both scan levels
    out = C.solve_states(drive, solver, length=32, fan=8).toPandas().sort_values(["channel_idx", "sample_idx"])
    f = matrix_of(drive, "f")
    for ch, part in out.groupby("channel_idx"):
        a, c = solve(f[ch], solver == "rk4")
        np.testing.assert_allclose(part["a"], a, atol=1e-12)
        np.testing.assert_allclose(part["c"], c, atol=1e-12)


def test_scan_levels_agree(to_samples, synthetic):
    drive = C.normalise(C.rms_envelope(to_samples(synthetic[:1])))
    one = C.solve_states(drive).toPandas().sort_values("sample_idx")
    many = C.solve_states(drive, length=16, fan=3).toPandas().sort_values("sample_idx")
    assert np.allclose(one[["a", "c"]], many[["a", "c"]], atol=1e-12)


def test_dynamics_ranges_and_solver_agreement(to_samples, synthetic):
    samples = to_samples(synthetic[:2])
    euler = C.extract_dynamics(samples).toPandas().sort_values(["channel_idx", "sample_idx"])
    rk4 = C.extract_dynamics(samples, "rk4").toPandas().sort_values(["channel_idx", "sample_idx"])
    assert euler[["a", "c"]].min().min() >= 0 and euler[["a", "c"]].max().max() <= 1
    assert euler["b"].between(0, 2 * np.pi, inclusive="left").all()
    assert np.corrcoef(euler["a"], rk4["a"])[0, 1] > 0.95


@pytest.mark.parametrize("n", [1000, 777])
def test_split_phase_equals_direct(to_samples, n):
    samples = to_samples(np.random.default_rng(4).normal(size=(2, n)))
    direct = matrix_of(C.instantaneous_phase(samples), "b")
    split = matrix_of(C.instantaneous_phase(samples, piece=100), "b")
    np.testing.assert_allclose(np.exp(1j * split), np.exp(1j * direct), atol=1e-9)


def test_flat_channel_is_bad(to_samples):
    m = np.random.default_rng(5).normal(size=(8, 500)) * np.array([1, 1.1, 0.9, 1, 1.05, 0.95, 1, 30])[:, None]
    assert [r.channel_idx for r in C.bad_channels(to_samples(m)).collect()] == [7]


def test_constant_variances_have_no_bad_channel(to_samples):
    assert C.bad_channels(to_samples(np.tile([1.0, -1.0], (4, 50)))).count() == 0


def test_unknown_normalisation(to_samples):
    with pytest.raises(ValueError):
        C.normalise(C.rms_envelope(to_samples(np.ones((1, 50)))), "other")
