"""Filters, envelopes, phase and state dynamics over whole recordings.

Every operator is exact for recordings of any length and cuts them into chunks:

* FIR filters need ``(taps - 1) / 2`` neighbours on each side;
* the causal notch is its impulse response, cut where it is below double
  rounding, so a left halo is enough;
* the state equations are affine in the state, so each chunk is summarised by
  one (multiplier, offset) pair, the pairs are scanned, and chunks are replayed
  from their own start state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..dims import ENVELOPE_SEC, EQUATIONS, SAMPLE_RATE
from ..functions import kernels
from ..functions.frames import together
from ..functions.layout import CHUNK, KEYS, chunk_arrays, gapless, own, placed, section_join, sorted_groups, with_halo
from .longphase import split_phase, with_stretches

FILTER_CHUNK = 8192
#: Short, so that the 10,000 chunks of an Arrow batch are some 40 MB.
PHASE_CHUNK = 256
_ROWS = 20_000


def _fir_stage(x: np.ndarray, at_start: bool, at_end: bool, taps: np.ndarray) -> np.ndarray:
    """Filter an array that misses ``half`` neighbours only at a stretch's ends, which are reflected."""
    half = (len(taps) - 1) // 2
    padded = kernels.odd_reflect(x, half, half)
    lo, hi = (0 if at_start else half), (len(padded) if at_end else len(padded) - half)
    return kernels.convolve_valid(padded[lo:hi], taps)


def _per_stretch(samples: DataFrame, keys: list[str], chunk: int, left: int, right: int, kernel) -> DataFrame:
    """(keys, sample_idx, uv) from ``kernel(x, at_start, at_end) -> (y, how many leading entries it lacks)``.

    A recording may begin at any index and miss samples: each gapless stretch is filtered on its
    own and keeps its indexes. The neighbours a chunk carries show whether a stretch ends there;
    it goes on only if it reaches the chunk's outermost neighbour.
    """
    arrays = chunk_arrays(samples, chunk, left, right, keys, positions=True)

    @F.pandas_udf("struct<i:array<bigint>,y:array<double>>")
    def run(no: pd.Series, p: pd.Series, x: pd.Series) -> pd.DataFrame:
        out = []
        for c, at, v in zip(no, p, x):
            at, v, lo, hi = np.asarray(at), np.asarray(v), c * chunk, (c + 1) * chunk
            places, values = [], []
            for part in gapless(at):
                first, last = at[part.start], at[part.stop - 1]
                if last < lo or first >= hi:
                    continue
                y, lacks = kernel(v[part], first > lo - left or first == 0, last < hi + right - 1)
                a, b = max(lo, first), min(hi, last + 1)
                places.append(np.arange(a, b))
                values.append(y[a - first - lacks : b - first - lacks])
            out.append((np.concatenate(places), np.concatenate(values)))
        return pd.DataFrame(out, columns=["i", "y"])

    done = arrays.select(*keys, run("chunk", "p", "x").alias("r"))
    pairs = F.arrays_zip(F.col("r.i").alias("i"), F.col("r.y").alias("y"))
    return done.select(*keys, F.explode(pairs).alias("e")).select(*keys, F.col("e.i").alias("sample_idx"), F.col("e.y").alias("uv"))


def apply_fir(
    samples: DataFrame, stages: Sequence[np.ndarray], keys: Sequence[str] = KEYS, length: int = FILTER_CHUNK
) -> DataFrame:
    """Run zero-phase FIR stages one after another in a single shuffle.

    The ends of each gapless stretch are padded by point reflection before each stage.
    """
    halo = sum((len(t) - 1) // 2 for t in stages)

    def kernel(x: np.ndarray, at_start: bool, at_end: bool) -> tuple[np.ndarray, int]:
        lacks = 0
        for taps in stages:
            x = _fir_stage(x, at_start, at_end, taps)
            lacks += 0 if at_start else (len(taps) - 1) // 2
        return x, lacks

    return _per_stretch(samples, list(keys), max(length, halo + 1), halo, halo, kernel)


def notch_stage(fs: float = SAMPLE_RATE, freq: float = 60.0, quality: float = 30.0) -> np.ndarray:
    return kernels.bandstop_taps(freq, freq / quality, fs)


def bandpass_stage(
    fs: float = SAMPLE_RATE, low: float | None = 0.5, high: float | None = 50.0, method: str = "fir",
    per_edge: bool = True,
) -> np.ndarray:
    """Taps of the band-pass; an upper edge at or above Nyquist moves 1 Hz below it."""
    if high is not None and high >= fs / 2:
        high = fs / 2 - 1.0
    if method == "fir":
        return kernels.bandpass_taps(low, high, fs, per_edge)
    if method == "iir":
        return kernels.zero_phase_iir_taps(low, high, fs)
    raise ValueError(f"unknown filter method: {method}")


def notch(samples: DataFrame, freq: float = 60.0, quality: float = 30.0, fs: float = SAMPLE_RATE, **kw):
    return apply_fir(samples, [notch_stage(fs, freq, quality)], **kw)


def bandpass(
    samples: DataFrame, low: float | None = 0.5, high: float | None = 50.0, fs: float = SAMPLE_RATE,
    method: str = "fir", **kw,
) -> DataFrame:
    return apply_fir(samples, [bandpass_stage(fs, low, high, method)], **kw)


def highpass(samples: DataFrame, low: float = 1.0, fs: float = SAMPLE_RATE, **kw) -> DataFrame:
    return apply_fir(samples, [bandpass_stage(fs, low, None)], **kw)


def preprocess(
    samples: DataFrame, line_freq: float = 60.0, quality: float = 30.0, low: float = 0.5, high: float = 50.0,
    method: str = "fir", fs: float = SAMPLE_RATE, **kw,
) -> DataFrame:
    """Notch, then band-pass, with one exchange for both."""
    return apply_fir(samples, [notch_stage(fs, line_freq, quality), bandpass_stage(fs, low, high, method)], **kw)


def iir_notch(
    samples: DataFrame, freq: float = 60.0, q: float = 30.0, fs: float = SAMPLE_RATE,
    keys: Sequence[str] = KEYS, length: int = CHUNK,
) -> DataFrame:
    """Causal notch biquad from a zero initial state over each gapless stretch."""
    b, a = kernels.notch_biquad(freq, q, fs)
    h = kernels.impulse_response(b, a, kernels.decay_length(a))
    halo = len(h) - 1

    def kernel(x: np.ndarray, at_start: bool, at_end: bool) -> tuple[np.ndarray, int]:
        return kernels.convolve_valid(np.pad(x, (halo, 0)), h), 0

    return _per_stretch(samples, list(keys), max(length, halo), halo, 0, kernel)


def _samples_of(chunks: DataFrame, keys: list[str], given: Sequence[str], names: Sequence[str], kernel) -> DataFrame:
    """(keys, sample_idx, names): ``kernel`` of each chunk's given columns, ``p`` among them, as equally long arrays.

    A worker makes the samples of a few chunks at a time, however many an Arrow batch has.
    """
    made = [T.StructField("sample_idx", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)]
    schema = T.StructType([*(chunks.schema[k] for k in keys), *made])
    arrow = to_arrow_schema(schema)

    def entries(column: pa.Array) -> Sequence:
        if not pa.types.is_list(column.type):
            return column.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(column).to_numpy())
        return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.cumsum(pc.list_value_length(batch.column("p")).to_numpy().astype(np.int64)) // (4 * _ROWS)
            cuts = [0, *(np.flatnonzero(np.diff(held)) + 1), batch.num_rows]
            for some in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
                rows = [kernel(*row) for row in zip(*(entries(some.column(c)) for c in given))]
                of = pa.array(np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]))
                at, *values = (np.concatenate(c) for c in zip(*rows))
                data = [*(some.column(k).take(of) for k in keys), pa.array(at), *(pa.array(v, from_pandas=True) for v in values)]
                yield pa.RecordBatch.from_arrays(data, schema=arrow)

    return chunks.select(*keys, *given).mapInArrow(run, schema)


# ---------------------------------------------------------------- envelopes


def rms_envelope(
    samples: DataFrame, fs: float = SAMPLE_RATE, window_sec: float = ENVELOPE_SEC, keys: Sequence[str] = KEYS,
    length: int = CHUNK,
) -> DataFrame:
    """Moving root mean square, always divided by the window size (zeros where there is no sample)."""
    k = max(1, int(window_sec * fs))
    left, right = k // 2, k - 1 - k // 2
    keys = list(keys)

    def run(c: int, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, grid = c * length, np.zeros(length + left + right)
        grid[at - first + left] = np.nan_to_num(np.asarray(v, float)) ** 2
        total = np.convolve(grid, np.ones(k), "valid")
        mine = at[at // length == c]
        return mine, np.sqrt(total[mine - first] / k)

    return _samples_of(chunk_arrays(samples, length, left, right, keys, positions=True), keys, ["chunk", "p", "x"], ["rms"], run)


def normalise(
    envelope: DataFrame, method: str = "minmax", keys: Sequence[str] = KEYS, value: str = "rms",
    epsilon: float = 1e-10,
) -> DataFrame:
    """Scale a channel's envelope to [0, 1] as column ``f``."""
    x = F.col(value)
    if method == "minmax":
        stats = [F.min(x).alias("_lo"), F.max(x).alias("_hi")]
        scaled = (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + epsilon)
    elif method == "zscore":
        stats = [F.avg(x).alias("_lo"), F.stddev_pop(x).alias("_hi")]
        scaled = 1.0 / (1.0 + F.exp(-(x - F.col("_lo")) / (F.col("_hi") + epsilon)))
    else:
        raise ValueError(f"unknown normalisation: {method}")
    per_channel = envelope.groupBy(*keys).agg(*stats, F.min("sample_idx").alias("_first"), F.max("sample_idx").alias("_last"))
    rows = section_join(envelope, per_channel, keys, "_last", first="_first")
    return rows.withColumn("f", scaled).drop("_lo", "_hi", "_first", "_last", value)


# ---------------------------------------------------------------- state equations


def _step_maps(at: np.ndarray, f: np.ndarray, chunk: int, length: int, solver: str, rate: float, initial: float, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Affine maps (m, q) of one state, y' = m y + q, for the chunk's own samples; ``at`` may hold the one before.

    A sample without a predecessor, at whatever index, resets to the initial value (m = 0).
    """
    f0, f1 = np.concatenate([[0.0], f[:-1]]), f
    if solver == "euler":
        m, q = 1 + dt * (rate - f0), dt * f0
    elif solver == "rk4":
        m, q = _rk4_map(rate, f0, f1, dt)
    else:
        raise ValueError(f"unknown solver: {solver}")
    first = np.diff(at, prepend=at[:1] - 2) != 1
    own = at // length == chunk
    return np.where(first, 0.0, m)[own], np.where(first, initial, q)[own]


def _rk4_map(rate: float, f0: np.ndarray, f1: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Multiplier and offset of one classical Runge-Kutta step of y' = rate y + f (1 - y)."""
    fm = 0.5 * (f0 + f1)
    g0, gm, g1 = rate - f0, rate - fm, rate - f1
    # slopes as (coefficient of y, constant)
    k1 = (g0, f0)
    k2 = (gm * (1 + dt / 2 * k1[0]), gm * (dt / 2) * k1[1] + fm)
    k3 = (gm * (1 + dt / 2 * k2[0]), gm * (dt / 2) * k2[1] + fm)
    k4 = (g1 * (1 + dt * k3[0]), g1 * dt * k3[1] + f1)
    return tuple((1 if i == 0 else 0) + dt / 6 * (k1[i] + 2 * k2[i] + 2 * k3[i] + k4[i]) for i in (0, 1))


def _run(m, q, s: float) -> np.ndarray:
    """States after each step of s' = m s + q: the maps are composed over distances 1, 2, 4, ..."""
    m, q = np.array(m, dtype=float), np.array(q, dtype=float)
    reach = 1
    while reach < len(m):
        q[reach:] += m[reach:] * q[:-reach]
        m[reach:] *= m[:-reach]
        reach *= 2
    return m * s + q


_FOUR = ("ma", "qa", "mc", "qc")


def _composed(*maps: Column) -> Column:
    """Fold a row's maps of both states into one map each."""

    @F.pandas_udf("struct<ma:double,qa:double,mc:double,qc:double>")
    def run(ma: pd.Series, qa: pd.Series, mc: pd.Series, qc: pd.Series) -> pd.DataFrame:
        out = {"ma": [np.prod(v) for v in ma], "mc": [np.prod(v) for v in mc]}
        out["qa"] = [_run(m, q, 0.0)[-1] for m, q in zip(ma, qa)]
        out["qc"] = [_run(m, q, 0.0)[-1] for m, q in zip(mc, qc)]
        return pd.DataFrame(out)[list(_FOUR)]

    return run(*maps)


def _before(*columns: Column) -> Column:
    """Both states before each of a row's maps; the last two columns are the states it starts from."""

    @F.pandas_udf("struct<a:array<double>,c:array<double>>")
    def run(ma: pd.Series, qa: pd.Series, mc: pd.Series, qc: pd.Series, sa: pd.Series, sc: pd.Series) -> pd.DataFrame:
        rows = zip(ma, qa, mc, qc, sa, sc)
        out = [(np.r_[a0, _run(va, wa, a0)[:-1]], np.r_[c0, _run(vc, wc, c0)[:-1]]) for va, wa, vc, wc, a0, c0 in rows]
        return pd.DataFrame(out, columns=["a", "c"])

    return run(*columns)


def _packed(place: str) -> Column:
    fields = [F.col(f"t.{n}").alias(n) for n in _FOUR]
    return F.array_sort(F.collect_list(F.struct(F.col(place).alias("i"), *fields))).alias("g")


def _maps() -> list[Column]:
    return [F.col(f"g.{n}") for n in _FOUR]


def _states_before(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name, sa, sc): both states before each map of the packed rows, from the rows' a0 and c0."""
    inner = rows.select(*keys, F.col("g.i").alias("i"), _before(*_maps(), F.col("a0"), F.col("c0")).alias("s"))
    one = F.explode(F.arrays_zip(F.col("i"), F.col("s.a").alias("a"), F.col("s.c").alias("c"))).alias("z")
    return inner.select(*keys, one).select(*keys, F.col("z.i").alias(name), F.col("z.a").alias("sa"), F.col("z.c").alias("sc"))


def _chunk_starts(totals: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """(keys, chunk, sa, sc): both states before each chunk, scanned in two levels.

    The maps of ``fan`` neighbouring chunks become one, and those of a key meet in a row: with chunks and a
    fan of 4096 such a row has one entry per 37 hours of a recording at 125 Hz.
    """
    groups = totals.withColumn("up", F.expr(f"chunk div {fan}")).groupBy(*keys, "up").agg(_packed("chunk"))
    tops = groups.select(*keys, "up", _composed(*_maps()).alias("t")).groupBy(*keys).agg(_packed("up"))
    tops = tops.withColumn("a0", F.lit(0.0)).withColumn("c0", F.lit(0.0))
    starts = groups.join(_states_before(tops, keys, "up").withColumnsRenamed({"sa": "a0", "sc": "c0"}), [*keys, "up"])
    return _states_before(starts, keys, "chunk")


def solve_states(
    driven: DataFrame, solver: str = "euler", equations: dict[str, tuple[float, float]] = EQUATIONS,
    fs: float = SAMPLE_RATE, keys: Sequence[str] = KEYS, length: int = CHUNK, fan: int = 4096,
) -> DataFrame:
    """(keys, sample_idx, a, c): both states, clipped to [0, 1] after the recurrence.

    The drive is exchanged once, as chunks that carry the sample before them. A chunk's steps are affine in the
    state, so it is one map; the maps are scanned and each chunk is replayed from its own start.
    """
    keys = list(keys)
    if solver not in ("euler", "rk4"):
        raise ValueError(f"unknown solver: {solver}")
    (rate_a, first_a), (rate_c, first_c) = equations["a"], equations["c"]
    dt = 1.0 / fs

    def both(chunk: int, at: np.ndarray, f: np.ndarray) -> list[np.ndarray]:
        f = np.asarray(f, float)
        return [x for rate, first in ((rate_a, first_a), (rate_c, first_c)) for x in _step_maps(at, f, chunk, length, solver, rate, first, dt)]

    @F.pandas_udf("struct<ma:double,qa:double,mc:double,qc:double>")
    def total(chunk: pd.Series, p: pd.Series, x: pd.Series) -> pd.DataFrame:
        rows = []
        for c, at, f in zip(chunk, p, x):
            ma, qa, mc, qc = both(c, at, f)
            rows.append((np.prod(ma), _run(ma, qa, 0.0)[-1], np.prod(mc), _run(mc, qc, 0.0)[-1]))
        return pd.DataFrame(rows, columns=list(_FOUR))

    def replay(c: int, at: np.ndarray, f: np.ndarray, a0: float, c0: float) -> tuple[np.ndarray, ...]:
        ma, qa, mc, qc = both(c, at, f)
        return at[at // length == c], np.clip(_run(ma, qa, a0), 0.0, 1.0), np.clip(_run(mc, qc, c0), 0.0, 1.0)

    chunks = placed(chunk_arrays(driven, length, 1, 0, keys, value="f", positions=True), keys)
    chunks = chunks.where(F.expr(f"chunk div {fan}").isNotNull())  # as the scan's join will say
    totals = chunks.select(*keys, "chunk", total("chunk", "p", "x").alias("t"))
    joined = chunks.join(_chunk_starts(totals, keys, fan), [*keys, "chunk"])
    return _samples_of(joined, keys, ["chunk", "p", "x", "sa", "sc"], ["a", "c"], replay)


# ---------------------------------------------------------------- phase


def instantaneous_phase(samples: DataFrame, keys: Sequence[str] = KEYS, piece: int = 1 << 20, length: int = PHASE_CHUNK) -> DataFrame:
    """(keys, sample_idx, b): phase of the analytic signal of each gapless stretch, in [0, 2 pi).

    The transform needs a stretch's whole length. The samples are exchanged once, as short chunks; those of keys of up to
    ``piece`` samples (2.3 hours, 8 MB) meet as arrays and are transformed key by key, the transform of a longer
    stretch is split over tasks. Both are one plan, made without looking at the data: sizes are columns.
    """
    keys = list(keys)
    chunks = with_stretches(placed(chunk_arrays(samples, length, keys=keys, positions=True), keys), keys)
    return _direct_phase(chunks.where(F.col("_n") <= piece), keys).unionByName(split_phase(chunks.where(F.col("_n") > piece), keys))


def analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    z = np.fft.fft(x)
    z[1 : (n + 1) // 2] *= 2
    z[n // 2 + 1 :] = 0
    return np.fft.ifft(z)


def _direct_phase(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Each gapless stretch is transformed on its own and keeps its indexes; a task holds one key at a time.

    A sample without a value leaves its stretch without a phase.
    """
    schema = T.StructType([*(chunks.schema[k] for k in keys), *T.DataType.fromDDL("sample_idx long, b double").fields])
    arrow = to_arrow_schema(schema)

    def phases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, rows = [], 0
        for key, held in sorted_groups(batches, len(keys)):
            at, v = (np.concatenate([some.column(c).flatten().to_numpy(zero_copy_only=False) for some in held]) for c in ("p", "x"))
            b = np.concatenate([np.angle(analytic(v[part])) % (2 * np.pi) for part in gapless(at)])
            for i in range(0, len(at), _ROWS):
                some = at[i : i + _ROWS]
                known = [pa.repeat(pa.scalar(k, f.type), len(some)) for k, f in zip(key, arrow)]
                made.append(pa.RecordBatch.from_arrays([*known, pa.array(some), pa.array(b[i : i + _ROWS], from_pandas=True)], schema=arrow))
                rows += len(some)
                if rows >= _ROWS:
                    yield together(made)
                    made, rows = [], 0
        if made:
            yield together(made)

    near = chunks.select(*keys, "chunk", "p", "x").repartition(*keys).sortWithinPartitions(*keys, "chunk")
    return near.mapInArrow(phases, schema)


def extract_dynamics(
    samples: DataFrame, solver: str = "euler", fs: float = SAMPLE_RATE, keys: Sequence[str] = KEYS,
    method: str = "minmax", length: int = CHUNK,
) -> DataFrame:
    """(keys, sample_idx, a, b, c): envelope -> scaling -> states, with the phase as b."""
    keys = list(keys)
    drive = normalise(rms_envelope(samples, fs, keys=keys, length=length), method, keys)
    states = solve_states(drive, solver, fs=fs, keys=keys, length=length)
    phase = instantaneous_phase(samples, keys)
    return states.join(phase, [*keys, "sample_idx"]).select(*keys, "sample_idx", "a", "b", "c")


# ---------------------------------------------------------------- cleaning


def reject_epochs(epochs: DataFrame, keys: Sequence[str], threshold_uv: float = 150.0) -> DataFrame:
    """Epochs (keys) in which no channel's peak-to-peak exceeds the threshold."""
    per_channel = epochs.groupBy(*keys, "channel_idx").agg((F.max("uv") - F.min("uv")).alias("p2p"))
    return per_channel.groupBy(*keys).agg(F.max("p2p").alias("max_p2p")).where(
        F.col("max_p2p") <= threshold_uv
    )


def drop_rejected(epochs: DataFrame, keys: Sequence[str], threshold_uv: float = 150.0) -> DataFrame:
    return epochs.join(reject_epochs(epochs, keys, threshold_uv), list(keys), "left_semi")


def bad_channels(samples: DataFrame, z_threshold: float = 3.0) -> DataFrame:
    """Channels whose variance is far from the session's median by a robust z-score.

    Quantiles here are over a session's channels, a bounded set.
    """
    var = samples.groupBy("session_id", "channel_idx").agg(F.var_pop("uv").alias("variance"))
    med = var.groupBy("session_id").agg(F.percentile("variance", F.lit(0.5)).alias("med"))
    dev = var.join(med, "session_id").withColumn("dev", F.abs(F.col("variance") - F.col("med")))
    mad = dev.groupBy("session_id").agg(F.percentile("dev", F.lit(0.5)).alias("mad"))
    z = 0.6745 * (F.col("variance") - F.col("med")) / F.col("mad")
    return (
        dev.join(mad, "session_id")
        .where("mad > 0")
        .withColumn("z", z)
        .where(F.abs("z") > z_threshold)
        .select("session_id", "channel_idx", "variance", "z")
    )


def scale_by_session(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per-session channel z-score."""
    stats = samples.groupBy(*keys).agg(F.avg("uv").alias("_m"), F.stddev_pop("uv").alias("_s"), F.min("sample_idx").alias("_f"), F.max("sample_idx").alias("_l"))
    rows = section_join(samples, stats, keys, "_l", first="_f")
    return rows.withColumn("z", F.try_divide(F.col("uv") - F.col("_m"), F.col("_s"))).drop("_m", "_s", "_f", "_l")


# ---------------------------------------------------------------- epochs


def stimulus_epochs(
    samples: DataFrame, markers: DataFrame, tmin: float = -0.2, tmax: float = 0.8,
    baseline: tuple[float, float] | None = (-0.2, 0.0), fs: float = SAMPLE_RATE,
) -> DataFrame:
    """Samples around each marker, minus the epoch's baseline mean.

    A marker becomes the sample indexes it covers, so this is an equi join on
    (session, sample index); overlapping epochs each get their own copy. An epoch that
    misses a sample, at the recording's edge or in a gap, is left out.
    """
    lo, hi = int(round(tmin * fs)), int(round(tmax * fs))
    wanted = markers.select(
        "session_id", F.col("sample_index").alias("onset"), "label",
        F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("offset"),
    ).withColumn("sample_idx", F.col("onset") + F.col("offset"))
    cut = samples.select("session_id", "channel_idx", "sample_idx", "uv").join(
        wanted.where("sample_idx >= 0"), ["session_id", "sample_idx"]
    )
    w = Window.partitionBy("session_id", "channel_idx", "onset", "label")
    cut = cut.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == hi - lo + 1).drop("_n")
    if baseline is None:
        return cut
    b0, b1 = int(round(baseline[0] * fs)), int(round(baseline[1] * fs))
    before = F.avg(F.when(F.col("offset").between(b0, b1), F.col("uv"))).over(w)
    return cut.withColumn("uv", F.col("uv") - before)


def evoked(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("label", "channel_idx", "offset").agg(
        F.avg("uv").alias("uv"), F.count(F.lit(1)).alias("n")
    )
