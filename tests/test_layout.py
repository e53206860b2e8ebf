"""Layout helpers against plain window functions and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from encephalake.functions.layout import interval_join, next_in_order, numbered, running_sum, section_join
from encephalake.functions.quantiles import bucketed, exact_quantiles, exact_quantiles_of


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 'hot' holds most rows, and a third of its values are the same."""
    rng = np.random.default_rng(0)
    n = 3000
    key = np.where(rng.random(n) < 0.8, "hot", rng.choice(["x", "y", "z"], n))
    v = np.where(rng.random(n) < 0.34, 5.0, rng.normal(size=n).round(2) * 10)
    return pd.DataFrame({"key": key, "pos": rng.permutation(n) * 3, "v": v})


def test_numbered_and_running_sum(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = numbered(df, ["key"], F.expr("pos div 50"), [F.col("pos")])
    got = running_sum(got, ["key"], F.expr("pos div 50"), [F.col("pos")], "v").toPandas().sort_values(["key", "pos"])
    want = skewed.sort_values(["key", "pos"])
    assert (got["rn"].to_numpy() == want.groupby("key").cumcount().to_numpy()).all()
    np.testing.assert_allclose(got["running"], want.groupby("key")["v"].cumsum())


def test_next_in_order(spark, skewed):
    got = next_in_order(spark.createDataFrame(skewed), ["key"], "pos", ["pos", "v"], 17).toPandas()
    got = got.sort_values(["key", "pos"])
    want = skewed.sort_values(["key", "pos"])
    for c in ("pos", "v"):
        np.testing.assert_array_equal(got[f"next_{c}"].to_numpy(float), want.groupby("key")[c].shift(-1).to_numpy(float))


@pytest.mark.parametrize("bound", [4, 1 << 18])
def test_quantiles_equal_numpy(spark, skewed, bound):
    df = spark.createDataFrame(skewed)
    got = {r.key: (r.q1, r.med, r.q9) for r in exact_quantiles(df, ["key"], "v", {"q1": 0.25, "med": 0.5, "q9": 0.9}, bound).collect()}
    for key, part in skewed.groupby("key"):
        np.testing.assert_allclose(got[key], np.percentile(part["v"], [25, 50, 90]))
    both = exact_quantiles_of(df, [], {"a": ("v", 0.5), "b": ("pos", 0.1)}, bound).collect()[0]
    np.testing.assert_allclose([both.a, both.b], [np.median(skewed["v"]), np.percentile(skewed["pos"], 10)])


@pytest.mark.parametrize("bound, fan", [(4, 64), (4, 3), (50, 2)])
def test_no_bucket_is_above_the_bound(spark, skewed, bound, fan):
    """Levels until every bucket is small enough, in the values' order."""
    rows = spark.createDataFrame(skewed[["key", "v"]].drop_duplicates())
    got = bucketed(rows, ["key"], "v", bound, fan).toPandas().sort_values(["key", "v"])
    assert got.groupby(["key", "_b"]).size().max() <= bound
    assert all(g["_b"].is_monotonic_increasing for _, g in got.groupby("key"))


def test_section_join_covers_every_section(spark, skewed):
    df = spark.createDataFrame(skewed)
    stats = df.groupBy("key").agg(F.max("pos").alias("last"))
    out = section_join(df, stats, ["key"], "last", "pos", section=100)
    assert out.count() == len(skewed)


def test_interval_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    points = pd.DataFrame({"k": "a", "p": rng.uniform(0, 100, 200)})
    spans = pd.DataFrame({"k": "a", "s": rng.uniform(0, 90, 30)})
    spans["e"] = spans["s"] + rng.uniform(0, 25, 30)
    cond = (F.col("p") >= F.col("s")) & (F.col("p") < F.col("e"))
    got = interval_join(spark.createDataFrame(points), spark.createDataFrame(spans), ["k"], "p", "s", "e", cond, 7.0)
    want = sum(((points["p"] >= r.s) & (points["p"] < r.e)).sum() for r in spans.itertuples())
    assert got.count() == want
