"""Independent components of recordings: fit, flag, apply.

A session can hold most of the data, so no step gathers one.  Statistics of a
few seconds of all channels are summed per block and combined; unmixing
matrices live in a table with one row per session and advance by joins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import CHANNEL_NAMES, EOG_PROXIES
from ..functions.iterate import fixed_point, matrix_sums
from ..functions.layout import spread_join

#: An Arrow batch has up to 10,000 blocks, which a Python worker holds at once, so a block is kept short.
BLOCK = 32


def _points(samples: DataFrame, block: int) -> DataFrame:
    """(session_id, win, g): the rows of a block of time points, ordered by point and channel."""
    packed = F.array_sort(F.collect_list(F.struct("sample_idx", "channel_idx", "uv")))
    rows = samples.select("session_id", "channel_idx", "sample_idx", "uv")
    return rows.groupBy("session_id", F.expr(f"sample_idx div {block}").alias("win")).agg(packed.alias("g"))


def sample_blocks(samples: DataFrame, n_channels: int = 16, block: int = BLOCK) -> DataFrame:
    """(session_id, win, idx, x): blocks of complete time points, x is m x C row-major."""
    points = _points(samples, block)

    @F.pandas_udf("struct<idx:array<bigint>,x:array<double>>")
    def complete(idx: pd.Series, x: pd.Series) -> pd.DataFrame:
        rows = []
        for i, v in zip(idx, x):
            at, inverse, n = np.unique(i, return_inverse=True, return_counts=True)
            rows.append((at[n == n_channels], np.asarray(v)[n[inverse] == n_channels]))
        return pd.DataFrame(rows, columns=["idx", "x"])

    done = points.select("session_id", "win", complete(F.col("g.sample_idx"), F.col("g.uv")).alias("b"))
    return done.select("session_id", "win", "b.idx", "b.x").where(F.size("x") > 0)


def _moment_sums(samples: DataFrame, c: int, block: int = BLOCK) -> DataFrame:
    """(session_id, total): count, sums and cross products of the channels."""

    @F.pandas_udf("array<double>")
    def moments(x: pd.Series) -> pd.Series:
        out = []
        for v in x:
            m = v.reshape(-1, c)
            out.append(np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()]))
        return pd.Series(out)

    blocks = sample_blocks(samples, c, block).select("session_id", moments("x").alias("v"))
    return matrix_sums(blocks, ["session_id"], "v").select("session_id", "total")


def _mean_and_cov(total: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    n, mean = total[0], total[1 : c + 1] / total[0]
    return mean, total[c + 1 :].reshape(c, c) / n - np.outer(mean, mean)


def fit_ica(
    samples: DataFrame, n_components: int = 15, n_channels: int = 16, seed: int = 42, max_iter: int = 60,
    tol: float = 1e-4, block: int = BLOCK, **loop,
) -> DataFrame:
    """(session_id, mean, unmixing, mixing): symmetric fixed-point ICA per session.

    ``unmixing`` is k x C, ``mixing`` C x k.  Give it high-passed samples.  A round
    is one map over blocks and one small aggregate; sessions advance together and
    stop on their own.
    """
    c, k = n_channels, min(n_components, n_channels)
    sizes = np.cumsum([c, k * c, k * k])

    def parts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return s[: sizes[0]], s[sizes[0] : sizes[1]].reshape(k, c), s[sizes[1] :].reshape(k, k)

    @F.pandas_udf("array<double>")
    def whitening(total: pd.Series) -> pd.Series:
        out = []
        for t in total:
            mean, cov = _mean_and_cov(np.asarray(t), c)
            w, v = np.linalg.eigh(cov)
            top = np.argsort(w)[::-1][:k]
            white = (v[:, top] / np.sqrt(np.maximum(w[top], 1e-12))).T
            q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))
            out.append(np.concatenate([mean, white.ravel(), q.ravel()]))
        return pd.Series(out)

    def contribute(rows: list, s: np.ndarray) -> np.ndarray:
        mean, white, w = parts(s)
        z = (np.concatenate(rows).reshape(-1, c) - mean) @ white.T
        g = np.tanh(z @ w.T)
        return np.concatenate([[len(z)], (1 - g**2).sum(axis=0), (g.T @ z).ravel()])

    def update(total: np.ndarray, n: int, s: np.ndarray) -> tuple[np.ndarray, bool]:
        _, _, old = parts(s)
        count, slope, cross = total[0], total[1 : k + 1], total[k + 1 :].reshape(k, k)
        u, _, vt = np.linalg.svd(cross / count - (slope / count)[:, None] * old)
        new = u @ vt
        moved = np.max(np.abs(np.abs(np.sum(new * old, axis=1)) - 1))
        return np.concatenate([s[: sizes[1]], new.ravel()]), bool(moved < tol)

    start = _moment_sums(samples, c, block).select("session_id", whitening("total").alias("s"))
    blocks = sample_blocks(samples, c, block)
    fitted = fixed_point(blocks, ["session_id"], "x", start, contribute, update, max_iter, **loop)

    @F.pandas_udf("struct<mean:array<double>,unmixing:array<double>,mixing:array<double>>")
    def finish(state: pd.Series) -> pd.DataFrame:
        rows = []
        for s in state:
            mean, white, w = parts(np.asarray(s))
            un = w @ white
            rows.append((mean, un.ravel(), np.linalg.pinv(un).ravel()))
        return pd.DataFrame(rows, columns=["mean", "unmixing", "mixing"])

    return fitted.select("session_id", finish("s").alias("f")).select("session_id", "f.*")


def activations(samples: DataFrame, ica: DataFrame, n_channels: int = 16, block: int = BLOCK) -> DataFrame:
    """(session_id, sample_idx, component, value): the components' time courses at the complete time points."""
    c = n_channels

    @F.pandas_udf("array<array<double>>")
    def unmix(x: pd.Series, mean: pd.Series, unmixing: pd.Series) -> pd.Series:
        return pd.Series([list((v.reshape(-1, c) - np.asarray(m)) @ np.asarray(u).reshape(-1, c).T) for v, m, u in zip(x, mean, unmixing)])

    blocks = spread_join(sample_blocks(samples, c, block), ica.select("session_id", "mean", "unmixing"), ["session_id"], F.col("win"))
    points = blocks.select("session_id", F.explode(F.arrays_zip("idx", unmix("x", "mean", "unmixing").alias("y"))).alias("z"))
    return points.select("session_id", F.col("z.idx").alias("sample_idx"), F.posexplode("z.y").alias("component", "value"))


def flag_eye_components(
    samples: DataFrame, ica: DataFrame, eog_idx: Sequence[int] = tuple(CHANNEL_NAMES.index(n) for n in EOG_PROXIES), z_threshold: float = 3.0,
    n_channels: int = 16, max_rounds: int = 10,
) -> DataFrame:
    """(session_id, component, score, flagged): components that follow the frontal channels.

    Correlations come from the session's moment sums (C x C), so the samples are
    read once.  Scores are z-scored per proxy, flagged ones removed and the rest
    scored again until none is left above the threshold.
    """
    c = n_channels

    sums = _moment_sums(samples, c)

    @F.pandas_udf("array<struct<component:int,score:double,flagged:boolean>>")
    def score(total: pd.Series, unmixing: pd.Series) -> pd.Series:
        out = []
        for t, un in zip(total, unmixing):
            _, cov = _mean_and_cov(np.asarray(t), c)
            u = np.asarray(un).reshape(-1, c)
            std = np.sqrt(np.maximum(np.sum((u @ cov) * u, axis=1), 1e-300))
            best, flags = np.zeros(len(u)), np.zeros(len(u), dtype=bool)
            for e in eog_idx:
                r = (u @ cov)[:, e] / (std * np.sqrt(cov[e, e]))
                best = np.where(np.abs(r) > np.abs(best), r, best)
                flags |= _outliers(np.abs(r), z_threshold, max_rounds)
            out.append(
                [dict(component=i, score=float(s), flagged=bool(f)) for i, (s, f) in enumerate(zip(best, flags))]
            )
        return pd.Series(out)

    return (
        sums.join(ica, "session_id")
        .select("session_id", F.explode(score("total", "unmixing")).alias("s"))
        .select("session_id", "s.*")
    )


def _outliers(x: np.ndarray, threshold: float, rounds: int) -> np.ndarray:
    bad = np.zeros(len(x), dtype=bool)
    for _ in range(rounds):
        good = x[~bad]
        spread = good.std()
        if len(good) < 2 or spread == 0:
            break
        new = ~bad & ((x - good.mean()) / spread > threshold)
        if not new.any():
            break
        bad |= new
    return bad


def cleaning_matrices(ica: DataFrame, excluded: DataFrame, n_channels: int = 16) -> DataFrame:
    """(session_id, m, shift): the affine map that removes the excluded components.

    m = I - mixing[:, ex] unmixing[ex, :], shift = (I - m) mean.  ``excluded`` is
    (session_id, component); a session without any gets the identity.
    """
    c = n_channels
    drop = excluded.groupBy("session_id").agg(F.collect_set("component").alias("ex"))

    @F.pandas_udf("struct<m:array<double>,shift:array<double>>")
    def build(un: pd.Series, mix: pd.Series, mean: pd.Series, ex: pd.Series) -> pd.DataFrame:
        rows = []
        for u, m, mu, e in zip(un, mix, mean, ex):
            e = np.asarray(e, dtype=int)
            u, m = np.asarray(u).reshape(-1, c), np.asarray(m).reshape(c, -1)
            removed = m[:, e] @ u[e, :]
            rows.append(((np.eye(c) - removed).ravel(), removed @ np.asarray(mu)))
        return pd.DataFrame(rows, columns=["m", "shift"])

    empty = F.array().cast("array<int>")
    return (
        ica.join(drop, "session_id", "left")
        .select("session_id", build("unmixing", "mixing", "mean", F.coalesce("ex", empty)).alias("b"))
        .select("session_id", "b.m", "b.shift")
    )


def apply_matrices(samples: DataFrame, matrices: DataFrame, n_channels: int = 16, block: int = BLOCK) -> DataFrame:
    """(session_id, sample_idx, channel_idx, uv, complete): every time point mapped through its session's matrix (row-major) and shift.

    A time point that lacks a channel, or whose session has no matrix, comes back as it
    is with ``complete`` false.  Time points are packed once per block, so the volume
    shuffled is that of the samples themselves.
    """
    c = n_channels

    @F.pandas_udf("struct<uv:array<double>,complete:array<boolean>>")
    def run(idx: pd.Series, x: pd.Series, m: pd.Series, shift: pd.Series) -> pd.DataFrame:
        rows = []
        for i, v, a, s in zip(idx, x, m, shift):
            _, inverse, n = np.unique(i, return_inverse=True, return_counts=True)
            whole = n[inverse] == c if a is not None else np.zeros(len(i), bool)
            out = np.array(v, float)
            if whole.any():
                out[whole] = (out[whole].reshape(-1, c) @ np.asarray(a).reshape(c, c).T + np.asarray(s)).ravel()
            rows.append((out, whole))
        return pd.DataFrame(rows, columns=["uv", "complete"])

    blocks = spread_join(_points(samples, block), matrices, ["session_id"], F.col("win"), "left")
    mapped = run(F.col("g.sample_idx"), F.col("g.uv"), F.col("m"), F.col("shift")).alias("y")
    rows = blocks.select("session_id", "g", mapped).select("session_id", "g", "y.uv", "y.complete").select(
        "session_id", F.explode(F.arrays_zip("g", "uv", "complete")).alias("z")
    )
    uv = F.when(F.col("z.complete"), F.col("z.uv")).otherwise(F.col("z.g.uv")).alias("uv")
    return rows.select("session_id", "z.g.sample_idx", "z.g.channel_idx", uv, "z.complete")
