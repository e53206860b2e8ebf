import numpy as np
import pytest
from pyspark.sql import functions as F

from encephalake.dims import BENCH, SCALP
from encephalake.operators import quality as Q

T = np.arange(250) / 125


def metrics(spark, arrays, threshold=500.0):
    df = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(arrays)], "i int, x array<double>")
    return df.select("i", Q.quality_metrics(F.col("x"), threshold).alias("m")).select("i", "m.*").orderBy("i").collect()


def test_railed_share(spark):
    alternating = np.where(np.arange(100) % 2 == 0, 200.0, -200.0)
    some = np.zeros(100)
    some[:30] = 5000
    dc = 5000 + np.random.default_rng(0).normal(0, 10, 100)
    edge = np.where(np.arange(100) % 2 == 0, 500.0, -500.0)
    rows = metrics(spark, [np.ones(50), alternating, some, dc, edge])
    assert [r.rail_pct for r in rows] == [0, 0, 100, 0, 0]
    assert metrics(spark, [some], 2000.0)[0].rail_pct == pytest.approx(30.0)


def test_line_ratio(spark):
    hum, alpha = 20 * np.sin(2 * np.pi * 60 * T), 20 * np.sin(2 * np.pi * 10 * T)
    r = metrics(spark, [hum, alpha, hum + alpha, np.full(250, 5.0), []])
    assert r[0].line_ratio > 0.9 and r[1].line_ratio < 0.1 and 0.3 < r[2].line_ratio < 0.7
    assert r[3].line_ratio == 0 and r[3].std_uv == 0  # a flat line gives 0, not NaN
    assert (r[4].rail_pct, r[4].std_uv, r[4].line_ratio) == (0, 0, 0)  # so does an empty window


@pytest.mark.parametrize(
    "rail, std, line, profile, want",
    [
        (60, 15, 0, BENCH, 2), (10, 15, 0, BENCH, 1), (0, 15, 0.95, BENCH, 2), (0, 15, 0.15, BENCH, 0),
        (0, 60, 0.01, BENCH, 1), (0, 40, 0.20, BENCH, 0), (0, 12, 0.10, SCALP, 0), (0, 40, 0.20, SCALP, 1),
        (0, 0.5, 0.1, BENCH, 2), (0, 3, 0.1, BENCH, 1), (0, 600, 0.2, BENCH, 2), (5, 15, 0.1, BENCH, 1), (50, 15, 0.1, BENCH, 2),
    ],
)
def test_status(spark, rail, std, line, profile, want):
    df = spark.createDataFrame([(float(rail), float(std), float(line))], "rail_pct double, std_uv double, line_ratio double")
    assert Q.grade(df, profile).first()["status"] == want


def test_quiet_rule_only_where_asked(spark):
    df = spark.createDataFrame([(0.0, 31.0, 0.01)], "rail_pct double, std_uv double, line_ratio double")
    assert Q.grade(df, SCALP).first()["status"] == 1
    quiet_bench = spark.createDataFrame([(0.0, 49.0, 0.01)], "rail_pct double, std_uv double, line_ratio double")
    assert Q.grade(quiet_bench, BENCH).first()["status"] == 0


def test_board_check_edges(to_samples):
    m = np.array([[10.0, -10.0], [0.0, 0.0], [1.0, -1.0], [900.0, -900.0]])
    got = {r.channel_idx: r.check for r in Q.board_check(to_samples(m)).collect()}
    assert got == {0: "OK", 1: "FLAT", 2: "NOISY", 3: "NOISY"}
