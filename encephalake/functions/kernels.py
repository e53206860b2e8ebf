"""Small numpy helpers that run inside Arrow batches.

Each one works on a bounded array (a window, a chunk with its halo, a C x C
matrix) or on a stack of them.  Spark does the splitting and the combining.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# ---------------------------------------------------------------- filters


def lowpass_taps(cutoff: float, n: int, fs: float) -> np.ndarray:
    """Hamming-windowed sinc with unit gain at 0 Hz."""
    m = np.arange(n) - (n - 1) / 2
    h = np.sinc(2 * cutoff / fs * m) * np.hamming(n)
    return h / h.sum()


def _odd_length(transition: float, fs: float) -> int:
    n = int(round(3.3 * fs / transition))
    return n + 1 - n % 2


def _centred(h: np.ndarray, n: int) -> np.ndarray:
    pad = (n - len(h)) // 2
    return np.pad(h, pad)


def bandpass_taps(low: float | None, high: float | None, fs: float, per_edge: bool = True) -> np.ndarray:
    """Zero-phase FIR; transitions of a quarter of the edge, at least 2 Hz.

    Each edge is a low-pass as long as its own transition asks for, as the common
    EEG toolboxes do by default; ``per_edge=False`` gives both the longer length.
    """
    nyq = fs / 2
    edges = []
    if high is not None:
        t = min(max(0.25 * high, 2.0), nyq - high)
        edges.append((1.0, high + t / 2, _odd_length(t, fs)))
    if low is not None:
        t = min(max(0.25 * low, 2.0), low)
        edges.append((-1.0, low - t / 2, _odd_length(t, fs)))
    n = max(length for *_, length in edges)
    parts = [(sign, lowpass_taps(cut, length if per_edge else n, fs)) for sign, cut, length in edges]
    taps = sum(sign * _centred(h, n) for sign, h in parts)
    if high is None:
        taps[n // 2] += 1.0
    return taps


def bandstop_taps(freq: float, width: float, fs: float, transition: float = 0.5) -> np.ndarray:
    n = _odd_length(transition, fs)
    lo, hi = freq - width / 2 - transition / 2, freq + width / 2 + transition / 2
    taps = lowpass_taps(lo, n, fs) - lowpass_taps(hi, n, fs)
    taps[n // 2] += 1.0
    return taps


def notch_biquad(freq: float, q: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    w0 = 2 * np.pi * freq / fs
    g = 1.0 / (1.0 + np.tan(w0 / (2 * q)))
    b = g * np.array([1.0, -2 * np.cos(w0), 1.0])
    a = np.array([1.0, -2 * g * np.cos(w0), 2 * g - 1.0])
    return b, a


@lru_cache(maxsize=32)
def notch_matrix(freq: float, q: float, fs: float, n: int) -> np.ndarray:
    """n x n matrix that filters a window from rest."""
    h = impulse_response(*notch_biquad(freq, q, fs), n)
    lag = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0)


def impulse_response(b: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    """First ``n`` outputs of a direct-form filter for a unit impulse."""
    h = np.zeros(n)
    for i in range(n):
        h[i] = (b[i] if i < len(b) else 0.0) - sum(a[k] * h[i - k] for k in range(1, len(a)) if i >= k)
    return h


class BlockFilter:
    """A biquad in blocks: outputs and the state after them are products with fixed matrices."""

    def __init__(self, b: np.ndarray, a: np.ndarray, length: int = 256):
        step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
        gain = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
        self.length = length
        powers = [np.eye(2)]
        for _ in range(length):
            powers.append(step @ powers[-1])
        self.powers = np.array(powers)
        driven = np.array([p @ gain for p in powers[:length]])  # state k + 1 samples after a unit impulse
        h = np.concatenate([[b[0]], driven[: length - 1, 0]])
        lag = np.arange(length)[:, None] - np.arange(length)[None, :]
        self.outputs = np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0)
        self.to_state = driven[::-1]

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs for ``x`` from state ``z``, and the state after it."""
        y = np.empty(len(x))
        for start in range(0, len(x), self.length):
            part = x[start : start + self.length]
            n = len(part)
            y[start : start + n] = self.outputs[:n, :n] @ part + self.powers[:n, 0] @ z
            z = self.powers[n] @ z + part @ self.to_state[self.length - n :]
        return y, z


def decay_length(a: np.ndarray, floor: float = 1e-18) -> int:
    """Samples after which the impulse response is below double rounding."""
    radius = float(np.max(np.abs(np.roots(a))))
    return int(np.ceil(np.log(floor) / np.log(radius)))


def butterworth_sections(low: float, high: float, fs: float, order: int = 4):
    """Band-pass Butterworth as (b, a) biquads: prototype, band shift, bilinear."""
    warp = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    bw, w0 = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    k = np.arange(1, order + 1)
    proto = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    half = proto * bw / 2
    shift = np.sqrt(half**2 - w0**2)
    poles = np.concatenate([half + shift, half - shift])
    z = (2 * fs + poles) / (2 * fs - poles)
    z = z[np.imag(z) > 0]
    mid = np.exp(1j * 2 * np.arctan(w0 / (2 * fs)))
    out = []
    for p in z:
        b, a = np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * p.real, abs(p) ** 2])
        gain = abs(np.polyval(a, mid) / np.polyval(b, mid))
        out.append((b * gain, a))
    return out


def zero_phase_iir_taps(low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """Forward-backward Butterworth as one symmetric kernel (its autocorrelation)."""
    sections = butterworth_sections(low, high, fs, order)
    n = max(decay_length(a, 1e-14) for _, a in sections)
    size = 1 << int(np.ceil(np.log2(4 * n)))
    spectrum = np.ones(size // 2 + 1, dtype=complex)
    zinv = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)
    for b, a in sections:
        spectrum *= np.polyval(b[::-1], zinv) / np.polyval(a[::-1], zinv)
    r = np.fft.irfft(np.abs(spectrum) ** 2, size)
    return np.concatenate([r[-n:], r[: n + 1]])


def odd_reflect(x: np.ndarray, left: int, right: int) -> np.ndarray:
    """Pad with the point reflection of the signal, then zeros if it is too short."""
    kl, kr = min(left, len(x) - 1), min(right, len(x) - 1)
    head = 2 * x[0] - x[kl:0:-1]
    tail = 2 * x[-1] - x[-2 : -kr - 2 : -1]
    return np.concatenate([np.zeros(left - kl), head, x, tail, np.zeros(right - kr)])


def convolve_valid(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    n = len(x) + len(taps) - 1
    size = 1 << int(np.ceil(np.log2(n)))
    full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[:n]
    return full[len(taps) - 1 : len(x)]


# ---------------------------------------------------------------- spectra


def taper(name: str, n: int) -> np.ndarray:
    j = np.arange(n)
    if name == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * j / n)
    if name == "hamming":
        return 0.54 - 0.46 * np.cos(2 * np.pi * j / n)
    raise ValueError(f"unknown taper: {name}")


def tapered_fft(x: np.ndarray, window: str) -> np.ndarray:
    """FFT of mean-removed, tapered rows."""
    return np.fft.rfft((x - x.mean(axis=-1, keepdims=True)) * taper(window, x.shape[-1]), axis=-1)


def density(x: np.ndarray, fs: float, window: str) -> np.ndarray:
    """One-sided power density of each row."""
    n = x.shape[-1]
    p = np.abs(tapered_fft(x, window)) ** 2 / (fs * np.sum(taper(window, n) ** 2))
    p[..., 1 : (n - 1) // 2 + 1] *= 2
    return p


def relative_powers(psd: np.ndarray, fs: float, n: int, bands: dict[str, tuple[float, float]]) -> np.ndarray:
    """Trapezoid power of each band (half-open edges) over that of all bins, per row; ``n`` samples gave the spectra."""
    freq = np.arange(psd.shape[-1]) * fs / n
    parts = [np.trapezoid(psd[..., (freq >= lo) & (freq < hi)], dx=fs / n) for lo, hi in bands.values()]
    total = np.trapezoid(psd, dx=fs / n)
    return np.stack(parts, axis=-1) / np.where(total == 0, 1e-10, total)[..., None]


def window_coherence(x: np.ndarray, held: np.ndarray, lo: float, hi: float, nperseg: int, fs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean band coherence of each window's channel pairs from half-overlapping segments: (i, j, coherence, segments).

    ``x`` and ``held`` are windows x C x w, the results windows x pairs. A segment counts for the channels that
    miss none of its samples; without common segments or power the coherence is NaN.
    """
    m = min(nperseg, x.shape[-1])
    starts = range(0, x.shape[-1] - m + 1, max(1, m - m // 2))
    freq = np.arange(m // 2 + 1) * fs / m
    band = (freq >= lo) & (freq < hi)
    i, j = np.triu_indices(x.shape[1], 1)
    xy, xx, yy, both = (np.zeros((len(x), len(i), k)) for k in (band.sum(), band.sum(), band.sum(), 1))
    xy = xy.astype(complex)
    for s in starts:
        whole = held[..., s : s + m].all(axis=-1)
        z = np.where(whole[..., None], tapered_fft(x[..., s : s + m], "hann")[..., band], 0)
        power, pair = np.abs(z) ** 2, (whole[:, i] & whole[:, j])[..., None]
        xy += z[:, i].conj() * z[:, j]
        xx += power[:, i] * pair
        yy += power[:, j] * pair
        both += pair
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = np.where((xx * yy > 0) & (both > 0), np.abs(xy) ** 2 / (xx * yy), np.nan)
    return i, j, mean_of(ratio), both[..., 0]


def mean_of(x: np.ndarray) -> np.ndarray:
    """Mean over the last axis of what is not NaN; NaN if nothing is."""
    there = ~np.isnan(x)
    count = there.sum(axis=-1)
    return np.where(count > 0, np.where(there, x, 0).sum(axis=-1) / np.maximum(count, 1), np.nan)


def waveform_shape(x: np.ndarray, eps: float = 1e-10) -> dict[str, np.ndarray]:
    """Moments, Hjorth parameters, line length and zero crossings of each row; no moments beyond two of a flat row."""
    d1, d2 = np.diff(x, axis=-1), np.diff(x, 2, axis=-1)
    mean, var = x.mean(axis=-1), x.var(axis=-1)
    centred = x - mean[..., None]
    with np.errstate(invalid="ignore", divide="ignore"):
        skew = np.where(var > 0, (centred**3).mean(axis=-1) / var**1.5, np.nan)
        kurtosis = np.where(var > 0, (centred**4).mean(axis=-1) / var**2 - 3, np.nan)
    v1, v2 = d1.var(axis=-1), d2.var(axis=-1)
    mobility = np.sqrt(v1 / (var + eps))
    return {
        "mean": mean, "std": np.sqrt(var), "skew": skew, "kurtosis": kurtosis, "hjorth_activity": var, "hjorth_mobility": mobility,
        "hjorth_complexity": np.sqrt(v2 / (v1 + eps)) / (mobility + eps), "line_length": np.abs(d1).sum(axis=-1),
        "zero_crossings": (np.sign(x[..., 1:]) != np.sign(x[..., :-1])).sum(axis=-1).astype(float),
    }


# ---------------------------------------------------------------- small matrices


def shrink(x: np.ndarray, method: str) -> np.ndarray:
    """Covariance (population) of the rows of a C x n window, optionally shrunk."""
    p, n = x.shape
    x = x - x.mean(axis=1, keepdims=True)
    s = x @ x.T / n
    if method == "empirical":
        return s
    mu = np.trace(s) / p
    if method == "oas":
        alpha = np.mean(s**2)
        den = (n + 1) * (alpha - mu**2 / p)
        rho = 1.0 if den == 0 else min(1.0, (alpha + mu**2) / den)
    elif method == "lw":
        delta = (np.sum(s**2) - 2 * mu * np.trace(s) + p * mu**2) / p
        beta = (np.sum((x**2) @ (x**2).T) / n - np.sum(s**2)) / (p * n)
        rho = 0.0 if beta == 0 else min(beta, delta) / delta
    else:
        raise ValueError(f"unknown method: {method}")
    return (1 - rho) * s + rho * mu * np.eye(p)


def spd_function(m: np.ndarray, fn) -> np.ndarray:
    """Apply ``fn`` to the eigenvalues of symmetric matrices (stacked)."""
    w, v = np.linalg.eigh((m + np.swapaxes(m, -1, -2)) / 2)
    return (v * fn(w)[..., None, :]) @ np.swapaxes(v, -1, -2)


def spd_sqrt(m: np.ndarray) -> np.ndarray:
    return spd_function(m, lambda w: np.sqrt(np.maximum(w, 0.0)))


def log_map(base: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Affine-invariant tangent vector at ``base`` towards ``point``."""
    root = spd_sqrt(base)
    inv = np.linalg.inv(root)
    return root @ spd_function(inv @ point @ inv, np.log) @ root
