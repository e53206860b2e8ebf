"""State encoding of (a, b, c) per channel and similarity to class templates.

A segment's state is a product over channels of four complex amplitudes. The circuit that entangles
channels is the same fixed unitary for every segment, so similarities need only the product states, and
those only channel by channel: the inner product of two segments is the product of their channels' inner
products. A template, the normalised mean of its training states, is therefore kept as its training
segments' amplitudes and the norm of their sum; nothing grows with a power of the channels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import RING_ORDER
from ..functions.expr import rank_in

AMPLITUDES = ["00", "10", "01", "11"]  # first digit: excitatory state
MAX_TRAINING = 256  # segments that a template is fitted on: those whose keys have the smallest MD5
BLOCK = 4096  # segments and
TEMPLATES = 64  # templates that meet in a task, on average


def encode_states(df: DataFrame) -> DataFrame:
    """Add re_xx / im_xx for the four amplitudes of each row's (a, b, c).

    Roots use a and c clipped to [0, 1]; the interaction phase b (a - c) uses
    them as they are.
    """
    clip = lambda n: F.least(F.greatest(F.col(n), F.lit(0.0)), F.lit(1.0))
    a, c, b = clip("a"), clip("c"), F.col("b")
    phi = b * (F.col("a") - F.col("c"))
    size = {
        "00": F.sqrt((1 - a) * (1 - c)), "10": F.sqrt(a * (1 - c)),
        "01": F.sqrt((1 - a) * c), "11": F.sqrt(a * c),
    }
    angle = {"00": -(b + phi) / 2, "10": (b + phi) / 2, "01": (phi - b) / 2, "11": (b - phi) / 2}
    cols = [f(angle[k]) * size[k] for k in AMPLITUDES for f in (F.cos, F.sin)]
    names = [f"{p}_{k}" for k in AMPLITUDES for p in ("re", "im")]
    return df.select("*", *[c.alias(n) for c, n in zip(cols, names)])


def ring_order(df: DataFrame, channel: str = "channel") -> DataFrame:
    """Add ``ord``: the channel's place on the ring; channels off the ring are dropped."""
    return df.withColumn("ord", rank_in(F.col(channel), RING_ORDER)).where(F.col("ord").isNotNull())


def pair_kernels(encoded: DataFrame, pairs: DataFrame, keys: Sequence[str], channel: str = "channel_idx") -> DataFrame:
    """(pair columns, re, im, fidelity) for the *given* pairs of segments.

    ``pairs`` has ``<key>_1`` and ``<key>_2`` for every key.  Inner products per
    channel are multiplied over the channels (montage size) by a fold, because a
    product of complex numbers that may be zero is no sum of logarithms.
    """
    amps = [f"{p}_{k}" for k in AMPLITUDES for p in ("re", "im")]
    side = lambda n: encoded.select(
        *[F.col(k).alias(f"{k}_{n}") for k in keys], F.col(channel).alias("_ch"), *[F.col(x).alias(f"{x}_{n}") for x in amps]
    )
    ids = [f"{k}_{n}" for n in (1, 2) for k in keys]
    rows = pairs.select(*ids).join(side(1), [f"{k}_1" for k in keys]).join(side(2), [*[f"{k}_2" for k in keys], "_ch"])
    re = sum(F.col(f"re_{k}_1") * F.col(f"re_{k}_2") + F.col(f"im_{k}_1") * F.col(f"im_{k}_2") for k in AMPLITUDES)
    im = sum(F.col(f"re_{k}_1") * F.col(f"im_{k}_2") - F.col(f"im_{k}_1") * F.col(f"re_{k}_2") for k in AMPLITUDES)
    packed = F.array_sort(F.collect_list(F.struct("_ch", re.alias("re"), im.alias("im"))))
    one = F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    fold = F.aggregate(
        "g",
        one,
        lambda s, e: F.struct(
            (s["re"] * e["re"] - s["im"] * e["im"]).alias("re"), (s["re"] * e["im"] + s["im"] * e["re"]).alias("im")
        ),
    )
    out = rows.groupBy(*ids).agg(packed.alias("g")).select(*ids, fold.alias("z"))
    return out.select(
        *ids, "z.re", "z.im", (F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")).alias("fidelity")
    )


def segment_states(pn: DataFrame, keys: Sequence[str], n_channels: int) -> DataFrame:
    """(keys, amps): the channels' amplitudes of a segment in ring order, flattened re/im.

    Only segments with all ``n_channels`` channels are kept.
    """
    names = [f"{p}_{k}" for k in AMPLITUDES for p in ("re", "im")]
    packed = F.array_sort(F.collect_list(F.struct("ord", F.array(*names).alias("v"))))
    return (
        encode_states(ring_order(pn))
        .groupBy(*keys)
        .agg(packed.alias("g"))
        .where(F.size("g") == n_channels)
        .select(*keys, F.flatten(F.col("g.v")).alias("amps"))
    )


def _stacked(rows) -> np.ndarray:
    """Segments x channels x 4 complex amplitudes."""
    flat = np.stack([np.asarray(r, dtype=float) for r in rows])
    return flat.reshape(len(flat), -1, 4, 2).view(complex)[..., 0]


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """<left_i, right_j> of product states."""
    return np.einsum("ick,jck->ijc", left.conj(), right).prod(axis=-1)


def build_templates(states: DataFrame, scope: Sequence[str], keys: Sequence[str], training: int = MAX_TRAINING) -> DataFrame:
    """(scope, n_segments, members, norm): the training segments' amplitudes and |sum of their states|^2.

    A template is fitted on ``training`` segments at most; a group therefore never holds more. Which ones is
    decided by the MD5 of their ``keys`` joined by colons, so other engines can follow it.
    """
    scope = list(scope)
    digest = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))
    order = Window.partitionBy(*scope).orderBy(digest, *keys)
    chosen = states.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= training)
    groups = chosen.groupBy(*scope).agg(F.collect_list("amps").alias("members"), F.count(F.lit(1)).alias("n_segments"))

    @F.pandas_udf("double")
    def norm(members: pd.Series) -> pd.Series:
        return pd.Series([inner_products(z, z).sum().real for z in map(_stacked, members)])

    return groups.select(*scope, "n_segments", "members", norm("members").alias("norm"))


def _parts(rows: DataFrame, scope: Sequence[str], size: int) -> int:
    """Parts of about ``size`` rows that the largest scope needs."""
    counts = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")) if scope else rows.agg(F.count(F.lit(1)).alias("n"))
    return max(1, -(-(counts.agg(F.max("n")).first()[0] or 0) // size))


def template_fidelity(
    states: DataFrame, templates: DataFrame, keys: Sequence[str], scope: Sequence[str] = (), block: int = BLOCK, held: int = TEMPLATES
) -> DataFrame:
    """(keys, label, fidelity) of every segment to each template (of its scope, if one is given).

    Segments and templates are counted and dealt by hash into blocks of about ``block`` and parts of about
    ``held``; every block of a scope meets every part of it in a group of its own, so a group is bounded and
    neither a common scope nor many templates gather in a task.
    """
    keys, scope = list(keys), list(scope)
    states = states.select(*keys, *[c for c in scope if c not in keys], "amps")
    blocks, parts = _parts(states, scope, block), _parts(templates, scope, held)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = states.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")).withColumn("_part", every(parts))
    sides = templates.select(*scope, "label", "members", "norm").withColumn("_part", F.pmod(F.xxhash64("label"), F.lit(parts)).cast("int")).withColumn("_block", every(blocks))
    by = [*scope, "_block", "_part"]
    sides = sides.select(*[F.col(c).alias(f"{c}_") for c in by], F.col("label").alias("label_"), "members", "norm")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({c: pd.Series([], dtype=object) for c in [*keys, "label", "fidelity"]})]
        for i in range(0, len(left) if len(right) else 0, 256):
            part = left.iloc[i : i + 256]
            amps = _stacked(part.amps)
            for label, members, norm in zip(right.label_, right.members, right.norm):
                value = np.abs(inner_products(_stacked(members), amps).sum(axis=0)) ** 2 / norm
                found.append(pd.DataFrame({**{c: part[c].to_numpy(dtype=object) for c in keys}, "label": label, "fidelity": value}))
        return pd.concat(found[1:] or found, ignore_index=True)

    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *templates.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "label"]) + ", fidelity double"
    return rows.groupBy(*by).cogroup(sides.groupBy(*[f"{c}_" for c in by])).applyInPandas(score, schema)


def classify(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best template per segment; the first (smallest label) wins ties."""
    best = F.max_by(F.struct("label", "fidelity"), F.struct(F.col("fidelity"), -F.col("label")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.label").alias("prediction"), F.col("b.fidelity").alias("fidelity")
    )
