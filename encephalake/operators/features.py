"""Classical per-channel features and the joined feature vector."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import BANDS, SAMPLE_RATE
from ..functions import kernels
from ..functions.frames import halo_frames, over_frames
from ..functions.layout import CHUNK, KEYS, own, with_halo
from .spectral import band_powers, coherence, welch
from .windows import assign_windows

EPS = 1e-10
RATIO_PAIRS = list(combinations(BANDS, 2))


def band_ratios(powers: DataFrame) -> DataFrame:
    return powers.select(
        *[c for c in powers.columns if c not in BANDS],
        *[(F.col(a) / (F.col(b) + EPS)).alias(f"{a}_{b}_ratio") for a, b in RATIO_PAIRS],
    )


def _standard_moment(x: str, order: int) -> Column:
    """Population moment of order 3 or 4 from the built-in aggregates; NULL if flat."""
    return F.skewness(x) if order == 3 else F.kurtosis(x)


def waveform_features(
    spans: DataFrame, keys: Sequence[str], value: str = "uv", pos: str = "pos", count: str | None = None
) -> DataFrame:
    """Moments, Hjorth parameters, line length and zero crossings in one pass.

    Neighbours come from ``lead`` inside chunks of the span that carry their two
    right neighbours, so a span may be a 2 s window or a whole recording.
    ``count`` names an optional column with the number of samples.
    """
    w = Window.partitionBy(*keys, "chunk").orderBy(pos)
    x, n1, n2 = F.col(value), F.lead(value, 1).over(w), F.lead(value, 2).over(w)
    rows = with_halo(spans.select(*keys, pos, value), CHUNK, 0, 2, pos).select(
        *keys,
        own(CHUNK, pos).alias("_own"),
        x.alias("x"),
        (n1 - x).alias("d1"),
        (n2 - 2 * n1 + x).alias("d2"),
        (F.signum(n1) != F.signum(x)).cast("int").alias("zc"),
    )
    sums = rows.where("_own").groupBy(*keys).agg(
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        _standard_moment("x", 3).alias("skew"),
        _standard_moment("x", 4).alias("kurtosis"),
        F.var_pop("x").alias("hjorth_activity"),
        F.var_pop("d1").alias("_v1"),
        F.var_pop("d2").alias("_v2"),
        F.sum(F.abs("d1")).alias("line_length"),
        F.sum("zc").alias("zero_crossings"),
        *([F.count(F.lit(1)).alias(count)] if count else []),
    )
    mobility = F.sqrt(F.col("_v1") / (F.col("hjorth_activity") + EPS))
    return (
        sums.withColumn("hjorth_mobility", mobility)
        .withColumn(
            "hjorth_complexity",
            F.sqrt(F.col("_v2") / (F.col("_v1") + EPS)) / (F.col("hjorth_mobility") + EPS),
        )
        .drop("_v1", "_v2")
    )


def spectral_entropy(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normalised Shannon entropy of a spectrum, without a second pass over bins.

    The sum of p log2(p + eps) needs the total first; the total is a window over
    the span's own bins (at most nperseg / 2 + 1 of them).
    """
    w = Window.partitionBy(*keys)
    p = F.col("psd") / (F.sum("psd").over(w) + EPS)
    rows = psd.select(*keys, p.alias("p"))
    return rows.groupBy(*keys).agg(
        (-F.sum(F.col("p") * F.log2(F.col("p") + EPS)) / F.log2(F.count(F.lit(1)))).alias("spectral_entropy")
    )


SHAPE = [
    "mean", "std", "skew", "kurtosis", "hjorth_activity", "hjorth_mobility", "hjorth_complexity",
    "line_length", "zero_crossings",
]


def channel_features(
    spans: DataFrame,
    keys: Sequence[str],
    nperseg: int = 250,
    fs: float = SAMPLE_RATE,
    entropy: bool = True,
    averaged: bool = True,
) -> DataFrame:
    """One wide row per span: 5 powers, 10 ratios, 9 shape features, entropy.

    All joins are on the span keys, which every part is already clustered by.
    """
    keys = list(keys)
    psd = welch(spans, keys, nperseg, fs=fs, averaged=averaged)
    powers = band_powers(psd, keys, nperseg=nperseg, fs=fs)
    out = powers.select(
        *keys,
        *[F.col(b).alias(f"{b}_power") for b in BANDS],
        *[(F.col(a) / (F.col(b) + EPS)).alias(f"{a}_{b}_ratio") for a, b in RATIO_PAIRS],
    ).join(waveform_features(spans, keys), keys)
    if entropy:
        out = out.join(spectral_entropy(psd, keys), keys)
    return out


def feature_names(entropy: bool = True) -> list[str]:
    return (
        [f"{b}_power" for b in BANDS]
        + [f"{a}_{b}_ratio" for a, b in RATIO_PAIRS]
        + SHAPE
        + (["spectral_entropy"] if entropy else [])
    )


def feature_rows(
    spans: DataFrame,
    span_keys: Sequence[str],
    channel: str = "channel",
    nperseg: int = 250,
    with_coherence: bool = True,
    names: Sequence[str] | None = None,
    averaged: bool = True,
    coherence_nperseg: int | None = None,
) -> DataFrame:
    """(span keys, name, value): the whole named feature vector in long form.

    Channel features are named ``{channel}_{feature}`` and pairs
    ``coh_{channel}_{channel}``; pivot or ``map_from_entries`` give the vector.
    ``names`` maps channel_idx to a name for the pair features. For spans as long as
    whole recordings; ``window_features`` gives the same of sliding windows.
    """
    span_keys = list(span_keys)
    wide = channel_features(spans, [*span_keys, channel], nperseg, averaged=averaged)
    entries = F.array(
        *[F.struct(F.lit(n).alias("f"), F.col(n).cast("double").alias("v")) for n in feature_names()]
    )
    rows = wide.select(*span_keys, channel, F.explode(entries).alias("e")).select(
        *span_keys, F.concat_ws("_", F.col(channel), F.col("e.f")).alias("name"), F.col("e.v").alias("value")
    )
    if not with_coherence:
        return rows
    pairwise = coherence(spans, span_keys, nperseg=coherence_nperseg or nperseg)
    lookup = F.array(*[F.lit(n) for n in names])
    pair_rows = pairwise.select(
        *span_keys,
        F.concat_ws("_", F.lit("coh"), F.get(lookup, F.col("ch_i")), F.get(lookup, F.col("ch_j"))).alias("name"),
        F.col("coherence").alias("value"),
    )
    return rows.unionByName(pair_rows)


def window_features(
    samples: DataFrame, w: int, hop: int, names: Sequence[str], coherence_nperseg: int | None = None, fs: float = SAMPLE_RATE
) -> DataFrame:
    """(session_id, win, name, value): the named feature vector of every window, in long form.

    Spectra, coherence and shape come from the same slice of a halo frame, so the samples are exchanged once.
    A channel's window that misses a sample has no features; ``names`` maps channel_idx to a name.
    """
    named = np.array(names, dtype=object)

    def measure(frame):
        own = named[frame.channels]
        channel_names = np.array([[f"{c}_{f}" for f in feature_names()] for c in own], dtype=object)
        for wins, x, held in frame.slabs():
            whole = held.all(axis=2)
            at, ch = np.nonzero(whole)
            rows = x[at, ch]
            psd = kernels.density(rows, fs, "hann")
            powers = dict(zip(BANDS, kernels.relative_powers(psd, fs, w, BANDS).T))
            p = psd / (psd.sum(axis=1, keepdims=True) + EPS)
            made = [*powers.values(), *[powers[a] / (powers[b] + EPS) for a, b in RATIO_PAIRS]]
            made += list(kernels.waveform_shape(rows, EPS).values())
            made.append(-(p * np.log2(p + EPS)).sum(axis=1) / np.log2(p.shape[1]))
            i, j, pairs, segments = kernels.window_coherence(x, held & whole[..., None], 8.0, 13.0, coherence_nperseg or w, fs)
            pair_names = np.array([f"coh_{a}_{b}" for a, b in zip(own[i], own[j])], dtype=object)
            in_pairs, pair = np.nonzero(segments)
            values = np.concatenate([np.stack(made, axis=1).ravel(), pairs[in_pairs, pair]])
            yield {
                "win": np.concatenate([np.repeat(wins[at], len(made)), wins[in_pairs]]),
                "name": np.concatenate([channel_names[ch].ravel(), pair_names[pair]]),
                "value": pa.array(values, from_pandas=True),
            }

    frames = halo_frames(samples, w, hop)
    return over_frames(frames, ["session_id"], w, hop, "win bigint, name string, value double", measure)


def feature_vectors(rows: DataFrame, span_keys: Sequence[str]) -> DataFrame:
    """Feature names and values as two aligned arrays per span (bounded by the feature count)."""
    packed = F.array_sort(F.collect_list(F.struct("name", "value")))
    return rows.groupBy(*span_keys).agg(packed.alias("e")).select(
        *span_keys, F.col("e.name").alias("names"), F.col("e.value").alias("values")
    )


def multiscale(
    samples: DataFrame, widths: Sequence[int], hop: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Std and line length around the same centres at several window widths.

    Windows of the first width set the centres; a wider one contributes the window
    whose centre is nearest.  All widths share the hop, so this is an equi join on
    a computed window number.
    """
    keys = list(keys)
    out = None
    for w in widths:
        spans = assign_windows(samples.select(*keys, "sample_idx", "uv"), w, hop).withColumn("pos", F.col("sample_idx"))
        full = waveform_features(spans, [*keys, "win"], count="_n").where(F.col("_n") == w)
        part = full.select(*keys, "win", F.col("std").alias(f"std_{w}"), F.col("line_length").alias(f"line_length_{w}"))
        if out is None:
            first, out = w, part
        else:
            shift = F.floor((F.col("win") * hop + (first - w) / 2) / hop + 0.5).cast("bigint")
            out = out.withColumn("_wide", shift).join(part.withColumnRenamed("win", "_wide"), [*keys, "_wide"]).drop("_wide")
    return out


def amplitude_flags(spans: DataFrame, keys: Sequence[str], limit_uv: float = 150.0) -> DataFrame:
    """Spans in which any sample leaves +-limit."""
    return spans.groupBy(*keys).agg(F.max(F.abs("uv")).alias("peak_uv")).withColumn(
        "flagged", F.col("peak_uv") > limit_uv
    )
