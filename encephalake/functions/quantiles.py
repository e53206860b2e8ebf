"""Exact quantiles and running counts that never hold a whole group in a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .layout import spread_join

#: Distinct values of a key that are put in order in one task; a bucket with more is split, as often as it takes.
BOUND = 1 << 18
#: Parts that a bucket is split into.
FAN = 64


def bucketed(rows: DataFrame, keys: Sequence[str], value: str, bound: int = BOUND, fan: int = FAN) -> DataFrame:
    """Add ``_b``: buckets of ``value`` in its order, none with more than ``bound`` rows of a key.

    ``rows`` has distinct values per key. Buckets are counted, and those beyond the bound are split at
    approximate quantiles of their own values, level by level until none is left; keys that were never
    large are one bucket and cost the count only. Numbers of buckets grow with the order, with gaps.
    """
    keys = list(keys)
    probs = F.array(*[F.lit((i + 1) / fan) for i in range(fan - 1)])
    rows = rows.withColumn("_b", F.lit(0).cast("bigint"))
    while True:
        counted = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound)
        large = materialise(counted.drop("_n"), "large")
        if large.isEmpty():
            return rows
        inside = rows.join(large, [*keys, "_b"], "left_semi")
        edges = inside.groupBy(*keys, "_b").agg(F.percentile_approx(value, probs, F.lit(100 * fan)).alias("_edges"))
        split = spread_join(rows, edges, [*keys, "_b"], F.xxhash64(value), "left")
        part = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(0))
        part = F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(part)
        rows = materialise(split.withColumn("_b", F.col("_b") * fan + part).drop("_edges"), "split")


def sum_below(counts: DataFrame, keys: Sequence[str], value: str, weight: str, bound: int = BOUND) -> DataFrame:
    """Add ``before``, the exact sum of ``weight`` over smaller values of the key, and ``total``, that over all.

    ``counts`` has one row per (keys, value), so a heavily repeated value is a
    single row.  Sums are a running total inside buckets plus a table of bucket totals.
    """
    keys = list(keys)
    if not keys:  # one constant key, in as many buckets as it needs
        return sum_below(counts.withColumn("_g", F.lit(0)), ["_g"], value, weight, bound).drop("_g")
    placed = bucketed(materialise(counts, "counts"), keys, value, bound)
    totals = placed.groupBy(*keys, "_b").agg(F.sum(weight).alias("_n"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("total"))
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, [*keys, "_b"])
        .withColumn("before", F.col("_in") + F.col("_off"))
        .drop("_in", "_off", "_b")
    )


def exact_quantiles_of(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], bound: int = BOUND
) -> DataFrame:
    """Quantiles of several columns at once: ``{output: (column, p)}``.

    The columns become rows of one long table, so all of them share one pass.
    """
    keys = list(keys)
    columns = sorted({c for c, _ in wanted.values()})
    entries = F.array(*[F.struct(F.lit(c).alias("_m"), F.col(c).cast("double").alias("_v")) for c in columns])
    long = df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e._m", "e._v")
    probs = sorted({p for _, p in wanted.values()})
    got = exact_quantiles(long, [*keys, "_m"], "_v", {f"_q{i}": p for i, p in enumerate(probs)}, bound)
    pick = lambda c, p: F.max(F.when(F.col("_m") == c, F.col(f"_q{probs.index(p)}")))
    return got.groupBy(*keys).agg(*[pick(c, p).alias(name) for name, (c, p) in wanted.items()])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], bound: int = BOUND
) -> DataFrame:
    """Linear-interpolated quantiles, one column per name in ``probs``; nulls are left out."""
    keys = list(keys)
    if not keys:
        return exact_quantiles(df.withColumn("_g", F.lit(0)), ["_g"], value, probs, bound).drop("_g")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = sum_below(counts, keys, value, "n", bound)
    holds = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
    aggs = []
    for name, p in probs.items():
        rank = (F.col("total") - 1) * F.lit(p)
        low = F.floor(rank)
        lo = F.max(F.when(holds(low), F.col(value)))
        hi = F.max(F.when(holds(F.least(low + 1, F.col("total") - 1)), F.col(value)))
        aggs.append((lo + (hi - lo) * F.max(rank - low)).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
