"""Welch spectra, band powers, coherence and the band-power encoding.

The unit of work is one tapered segment of at most ``nperseg`` samples, never a
whole channel.  Averages over segments are ordinary partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import BANDS, FOCUS_PAIRS, SAMPLE_RATE, values_table
from ..functions import kernels
from ..functions.frames import halo_frames, over_frames
from ..functions.layout import KEYS, section_join, sorted_values
from .windows import assign_windows, center_sec

SPAN = ["span_len"]  # samples in the span a spectrum is taken of


def spans_from_windows(samples: DataFrame, w: int, hop: int) -> DataFrame:
    """Sliding windows as spans: adds ``win``, ``pos`` and ``span_len``."""
    return (
        assign_windows(samples, w, hop)
        .withColumn("pos", F.col("sample_idx") - F.col("win") * hop)
        .withColumn("span_len", F.lit(w).cast("bigint"))
    )


def spans_whole(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whole recordings as spans from their first to their last index; the bounds are joined back by section.

    A segment that misses a sample gives no spectrum.
    """
    bounds = samples.groupBy(*keys).agg(F.min("sample_idx").alias("_from"), F.max("sample_idx").alias("_to"))
    rows = section_join(samples, bounds, keys, "_to", first="_from")
    length = F.col("_to") - F.col("_from") + 1
    return rows.withColumn("span_len", length).withColumn("pos", F.col("sample_idx") - F.col("_from")).drop("_from", "_to")


def segments(
    spans: DataFrame, keys: Sequence[str], nperseg: int = 250, overlap: float = 0.5, value: str = "uv"
) -> DataFrame:
    """(keys, span_len, seg_no, x): full segments of min(nperseg, span_len) samples.

    Each sample goes to the at most two segments that hold it.  A span that is
    itself incomplete yields no segment that misses samples.
    """
    n = F.least(F.lit(nperseg), F.col("span_len")).cast("bigint")
    rows = spans.select(*keys, "span_len", "pos", value).withColumn("_n", n)
    hop = F.col("_n") - F.floor(F.col("_n") * F.lit(overlap)).cast("bigint")
    rows = rows.withColumn("_hop", F.greatest(F.lit(1), hop))
    last = F.expr("(span_len - _n) div _hop")
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - F.col("_n")) / F.col("_hop")) + 1).cast("bigint")
    final = F.least(last, F.expr("pos div _hop"))
    placed = (
        rows.where(first <= final)
        .withColumn("seg_no", F.explode(F.sequence(first, final)))
        .select(*keys, "span_len", "_n", "seg_no", "pos", value)
    )
    return (
        placed.groupBy(*keys, "span_len", "_n", "seg_no")
        .agg(sorted_values("pos", value).alias("x"))
        .where(F.size("x") == F.col("_n"))
        .drop("_n")
    )


#: Values that are stacked at a time, so an Arrow batch of long rows needs no copies of itself.
STACKED = 1 << 17


def _batched(x: pd.Series, fn) -> pd.Series:
    """Apply ``fn`` to equally long rows stacked, some at a time, keeping the row order."""
    out = np.empty(len(x), dtype=object)
    lengths = x.map(len).to_numpy()
    for n in np.unique(lengths):
        equal, step = np.flatnonzero(lengths == n), max(1, STACKED // max(1, n))
        for first in range(0, len(equal), step):
            at = equal[first : first + step]
            for i, row in zip(at, fn(np.stack(x.iloc[at].to_list()))):
                out[i] = row
    return pd.Series(out)


def density_column(x: str, fs: float = SAMPLE_RATE, taper: str = "hann") -> Column:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return _batched(v, lambda m: kernels.density(m, fs, taper))

    return run(F.col(x))


def welch(
    spans: DataFrame,
    keys: Sequence[str],
    nperseg: int = 250,
    overlap: float = 0.5,
    taper: str = "hann",
    fs: float = SAMPLE_RATE,
    averaged: bool = True,
) -> DataFrame:
    """(keys, span_len, k, freq, psd): mean one-sided density per bin.

    ``averaged=False`` says that every span has one segment (span_len <
    nperseg + hop), so the average, and its shuffle, are left out.
    """
    seg = segments(spans, keys, nperseg, overlap)
    bins = seg.select(
        *keys, "span_len", F.posexplode(density_column("x", fs, taper)).alias("k", "psd")
    )
    if averaged:
        bins = bins.groupBy(*keys, "span_len", "k").agg(F.avg("psd").alias("psd"))
    return bins.withColumn("freq", F.col("k") * F.lit(float(fs)) / F.least(F.lit(nperseg), F.col("span_len")))


def _trapezoid(inside: Column, df: Column) -> Column:
    """Trapezoid over the consecutive bins where ``inside`` holds (0 if fewer than two)."""
    p = F.when(inside, F.col("psd"))
    k = F.when(inside, F.col("k"))
    ends = F.min_by(p, k) + F.max_by(p, k)
    return F.coalesce(df * (F.sum(p) - ends / 2), F.lit(0.0))


def band_powers(
    psd: DataFrame,
    keys: Sequence[str],
    bands: dict[str, tuple[float, float]] = BANDS,
    nperseg: int = 250,
    fs: float = SAMPLE_RATE,
) -> DataFrame:
    """Relative power per band (half-open edges), all bands in one aggregate."""
    df = F.lit(float(fs)) / F.least(F.lit(nperseg), F.col("span_len"))
    f = F.col("freq")
    parts = [
        _trapezoid((f >= lo) & (f < hi), F.first(df)).alias(f"_{b}") for b, (lo, hi) in bands.items()
    ]
    total = _trapezoid(F.lit(True), F.first(df)).alias("_total")
    sums = psd.groupBy(*keys).agg(*parts, total)
    floor = F.when(F.col("_total") == 0, F.lit(1e-10)).otherwise(F.col("_total"))
    return sums.select(*keys, *[(F.col(f"_{b}") / floor).alias(b) for b in bands])


def band_mean(psd: DataFrame, keys: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Mean density over the closed band; 0 if the band holds no bin."""
    held = F.col("freq").between(lo, hi)
    return psd.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(held, F.col("psd"))), F.lit(0.0)).alias("band_power")
    )


def alpha_summary(psd: DataFrame, keys: Sequence[str], lo: float = 8.0, hi: float = 13.0) -> DataFrame:
    """Alpha power, its ratio to all bins, and the (first) peak in the closed band."""
    held = F.col("freq").between(lo, hi)
    peak = F.max_by(
        F.when(held, F.struct("freq", "psd")), F.when(held, F.struct(F.col("psd"), -F.col("freq")))
    )
    return (
        psd.groupBy(*keys)
        .agg(
            F.avg(F.when(held, F.col("psd"))).alias("alpha_power"),
            F.avg("psd").alias("total_power"),
            peak.alias("_p"),
        )
        .select(
            *keys,
            "alpha_power",
            "total_power",
            F.when(F.col("total_power") > 0, F.col("alpha_power") / F.col("total_power"))
            .otherwise(0.0)
            .alias("alpha_ratio"),
            F.col("_p.freq").alias("peak_freq"),
            F.col("_p.psd").alias("peak_power"),
        )
    )


# ---------------------------------------------------------------- coherence


def coherence(
    spans: DataFrame,
    keys: Sequence[str],
    lo: float = 8.0,
    hi: float = 13.0,
    nperseg: int = 250,
    fs: float = SAMPLE_RATE,
    pairs: Sequence[tuple[int, int]] | None = None,
    reference: int | None = None,
    segs_per_row: int = 32,
) -> DataFrame:
    """(keys, ch_i, ch_j, coherence): mean over the band's bins per channel pair, or per one in ``pairs`` or with ``reference``.

    ``keys`` identify the span without the channel.  Spectra are cut to the band
    before anything is gathered; a few segments of all channels (montage size)
    meet in a row, cross products are summed there, and the sums are combined by
    a partial aggregate, so neither channels x time nor all segments ever meet.
    """
    keys = list(keys)
    seg = segments(spans, [*keys, "channel_idx"], nperseg)

    @F.pandas_udf("array<double>")
    def band_bins(x: pd.Series) -> pd.Series:
        def one(m: np.ndarray) -> np.ndarray:
            f = np.arange(m.shape[1] // 2 + 1) * fs / m.shape[1]
            z = kernels.tapered_fft(m, "hann")[:, (f >= lo) & (f < hi)]
            return np.concatenate([z.real, z.imag], axis=1)

        return _batched(x, one)

    spectra = seg.select(
        *keys, "channel_idx", "seg_no", F.expr(f"seg_no div {segs_per_row}").alias("_block"), band_bins("x").alias("z")
    ).where(F.size("z") > 0)
    blocks = spectra.groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(F.struct("seg_no", "channel_idx", "z"))).alias("g")
    )

    fields = ["ch_i", "ch_j", "k", "re", "im", "sxx", "syy"]
    kinds = ["array<int>"] * 3 + ["array<double>"] * 4

    @F.pandas_udf("struct<" + ",".join(f"{n}:{t}" for n, t in zip(fields, kinds)) + ">")
    def cross(no: pd.Series, ch: pd.Series, z: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cross_sums(s, c, np.stack(list(v)), pairs, reference) for s, c, v in zip(no, ch, z)], columns=fields)

    rows = (
        blocks.select(*keys, cross(F.col("g.seg_no"), F.col("g.channel_idx"), F.col("g.z")).alias("c"))
        .select(*keys, F.explode(F.arrays_zip(*[F.col(f"c.{n}").alias(n) for n in fields])).alias("r"))
        .select(*keys, "r.*")
    )
    total = rows.groupBy(*keys, "ch_i", "ch_j", "k").agg(
        *[F.sum(v).alias(v) for v in ("re", "im", "sxx", "syy")]
    )
    ratio = F.try_divide(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.col("sxx") * F.col("syy"))
    return total.groupBy(*keys, "ch_i", "ch_j").agg(F.avg(ratio).alias("coherence"))


def _cross_sums(no, ch, z: np.ndarray, pairs, reference) -> list[np.ndarray]:
    """Cross and power sums of every channel pair over the segments both have."""
    half = z.shape[1] // 2
    segs, row = np.unique(no, return_inverse=True)
    chans, col = np.unique(ch, return_inverse=True)
    m = np.zeros((half, len(segs), len(chans)), dtype=complex)
    m[:, row, col] = (z[:, :half] + 1j * z[:, half:]).T
    held = np.zeros((len(segs), len(chans)))
    held[row, col] = 1.0
    cross = np.swapaxes(m.conj(), 1, 2) @ m  # bins x C x C
    power = np.swapaxes(np.abs(m) ** 2, 1, 2) @ held  # of i where j is present
    both = held.T @ held > 0
    i, j = np.triu_indices(len(chans), 1)
    wanted = both[i, j]
    if pairs is not None:
        listed = {tuple(sorted(p)) for p in pairs}
        wanted &= np.array([(int(chans[a]), int(chans[b])) in listed for a, b in zip(i, j)], dtype=bool)
    if reference is not None:
        wanted &= (chans[i] == reference) | (chans[j] == reference)
    i, j = i[wanted], j[wanted]
    x = cross[:, i, j].T.ravel()
    return [
        np.repeat(chans[i], half), np.repeat(chans[j], half), np.tile(np.arange(half), len(i)),
        x.real, x.imag, power[:, i, j].T.ravel(), power[:, j, i].T.ravel(),
    ]


def global_coherence(pairwise: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairwise.groupBy(*keys).agg(F.avg("coherence").alias("coherence"))


def focus_coherence(
    spans: DataFrame,
    keys: Sequence[str],
    bands: dict[str, tuple[float, float]],
    names: Sequence[str],
    pairs: Sequence[tuple[str, str]] = FOCUS_PAIRS,
) -> DataFrame:
    """(keys, pair, band, coherence) of named pairs only (channels are selected before any FFT)."""
    index = {n: i for i, n in enumerate(names)}
    held = [(a, b) for a, b in pairs if a in index and b in index]
    wanted = [tuple(sorted((index[a], index[b]))) for a, b in held]
    picked = spans.where(F.col("channel_idx").isin(sorted({i for p in wanted for i in p})))
    got = None
    for band, (lo, hi) in bands.items():
        one = coherence(picked, keys, lo, hi, pairs=wanted).withColumn("band", F.lit(band))
        got = one if got is None else got.unionByName(one)
    named = values_table(spans.sparkSession, ["ch_i", "ch_j", "pair"], [(i, j, f"{a}-{b}") for (a, b), (i, j) in zip(held, wanted)])
    return got.join(F.broadcast(named), ["ch_i", "ch_j"]).drop("ch_i", "ch_j")


# ---------------------------------------------------------------- encoding


def encode_bands(powers: DataFrame, b: Column | None = None) -> DataFrame:
    """a = beta + gamma, c = delta + theta, b = 2 pi x alpha power (or the given column)."""
    phase = (F.col("alpha") if b is None else b) * F.lit(2 * np.pi)
    return (
        powers.withColumn("a", F.col("beta") + F.col("gamma"))
        .withColumn("b", phase)
        .withColumn("c", F.col("delta") + F.col("theta"))
        .drop(*BANDS)
    )


def encode_multichannel(
    spans: DataFrame,
    keys: Sequence[str],
    mode: str = "global",
    nperseg: int = 250,
    coherence_nperseg: int | None = None,
    fs: float = SAMPLE_RATE,
    averaged: bool = True,
    reference: int | None = None,
) -> DataFrame:
    """(keys, channel_idx, a, b, c) per span.

    ``mode='global'`` takes b from the mean pairwise alpha coherence of the span
    (.5 if it has one channel); ``'per_channel'`` from the channel's own alpha
    power.  With one segment per span the coherence is 1 by construction; give a
    smaller ``coherence_nperseg`` for an informative value.  ``reference``
    restricts the pairs to those with that channel.
    """
    keys = list(keys)
    psd = welch(spans, [*keys, "channel_idx"], nperseg, fs=fs, averaged=averaged)
    powers = band_powers(psd, [*keys, "channel_idx"], nperseg=nperseg, fs=fs)
    if mode == "per_channel":
        return encode_bands(powers)
    if mode != "global":
        raise ValueError(f"unknown coherence mode: {mode}")
    pairwise = coherence(spans, keys, nperseg=coherence_nperseg or nperseg, fs=fs, reference=reference)
    shared = global_coherence(pairwise, keys)
    joined = powers.join(shared, keys, "left")
    return encode_bands(joined, F.coalesce("coherence", F.lit(0.5))).drop("coherence")


def encode_sliding(
    samples: DataFrame,
    window_sec: float = 2.0,
    step_sec: float = 0.5,
    fs: float = SAMPLE_RATE,
    mode: str = "global",
    coherence_nperseg: int | None = None,
) -> DataFrame:
    """(session_id, win, channel_idx, a, b, c, center_sec) over sliding windows; sizes are truncated to whole samples.

    Windows are slices of halo frames: one exchange of the samples, no row per window and sample. A channel's
    window that misses a sample has no row, nor any part in the coherence of the others.
    """
    w, step = int(window_sec * fs), int(step_sec * fs)
    if mode not in ("global", "per_channel"):
        raise ValueError(f"unknown coherence mode: {mode}")

    def encode(frame):
        for wins, x, held in frame.slabs():
            whole = held.all(axis=2)
            at, ch = np.nonzero(whole)
            powers = dict(zip(BANDS, kernels.relative_powers(kernels.density(x[at, ch], fs, "hann"), fs, w, BANDS).T))
            phase = powers["alpha"]
            if mode == "global":
                pairs = kernels.window_coherence(x, held & whole[..., None], 8.0, 13.0, coherence_nperseg or w, fs)[2]
                shared = kernels.mean_of(pairs)
                phase = np.where(np.isnan(shared), 0.5, shared)[at]
            yield {
                "win": wins[at], "channel_idx": frame.channels[ch], "a": powers["beta"] + powers["gamma"],
                "b": phase * 2 * np.pi, "c": powers["delta"] + powers["theta"],
            }

    frames = halo_frames(samples, w, step)
    out = over_frames(frames, ["session_id"], w, step, "win bigint, channel_idx int, a double, b double, c double", encode)
    return out.withColumn("center_sec", center_sec(w, step, fs))


def decibels(psd: DataFrame) -> DataFrame:
    return psd.withColumn("db", 10 * F.log10("psd"))


def compare_recordings(
    left: DataFrame, right: DataFrame, keys: Sequence[str], tol_db: float = 0.1, tol_hz: float = 0.5,
    tol_rms: float = 0.01,
) -> DataFrame:
    """Per channel: do two recordings agree in spectrum, alpha peak and RMS?

    ``left`` and ``right`` are mean spectra (keys, k, freq, psd).  The RMS is that
    of the mean-removed signal, the root of the spectrum's sum times its bin width.
    """
    keys = list(keys)
    a = left.select(*keys, "k", "freq", F.col("psd").alias("a"))
    b = right.select(*keys, "k", F.col("psd").alias("b"))
    held = F.col("freq").between(8.0, 13.0)
    peak = lambda c: F.max_by(F.when(held, F.col("freq")), F.when(held, F.struct(F.col(c), -F.col("freq"))))
    rows = a.join(b, [*keys, "k"]).withColumn("d", F.abs(10 * F.log10("a") - 10 * F.log10("b")))
    out = rows.groupBy(*keys).agg(
        F.max("d").alias("max_db"),
        F.avg((F.col("d") <= tol_db).cast("double")).alias("share_within"),
        F.abs(peak("a") - peak("b")).alias("peak_shift_hz"),
        F.abs(F.sqrt(F.sum("b")) / F.sqrt(F.sum("a")) - 1).alias("rms_change"),
    )
    agree = (F.col("max_db") <= tol_db) & (F.col("peak_shift_hz") <= tol_hz) & (F.col("rms_change") <= tol_rms)
    return out.withColumn("agrees", agree)
