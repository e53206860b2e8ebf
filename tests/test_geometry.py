import numpy as np
import pytest
from pyspark.sql import functions as F

from encephalake.functions import kernels
from encephalake.operators import geometry as G
from encephalake.operators import windows as W


def spd_set(rng, n, c, scale=1.0):
    a = rng.normal(size=(n, c, c)) * scale
    return a @ np.swapaxes(a, 1, 2) + 0.1 * np.eye(c)


def as_table(spark, sets):
    rows = [(k, i, m.ravel().tolist()) for k, ms in sets.items() for i, m in enumerate(ms)]
    return spark.createDataFrame(rows, "state string, win int, cov array<double>").withColumn("session_id", F.lit("a"))


def fixed_point(ms, its=50, tol=1e-8):
    m = ms.mean(axis=0)
    for _ in range(its):
        r = kernels.spd_sqrt(m)
        new = np.mean([kernels.spd_sqrt(r @ c @ r) for c in ms], axis=0)
        stop = np.linalg.norm(new - m) < tol
        m = new
        if stop:
            break
    return (m + m.T) / 2


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(0)
    return {"a": spd_set(rng, 10, 4), "b": spd_set(rng, 12, 4, 1.5)}


@pytest.mark.parametrize("limit", [1024, 0])
def test_means_equal_sequential_iteration(spark, sets, limit):
    """Both places for the state (driver and written table) give the same means."""
    got = G.frechet_means(as_table(spark, sets), ["state"], max_iter=4, max_driver_keys=limit).collect()
    for r in got:
        np.testing.assert_allclose(np.reshape(r["mean"], (4, 4)), fixed_point(sets[r["state"]], 4), atol=1e-9)


def test_mean_of_equal_matrices_is_the_matrix_scaled(spark):
    got = G.frechet_means(as_table(spark, {"a": np.stack([np.eye(3)] * 5)}), ["state"]).collect()[0]
    np.testing.assert_allclose(np.reshape(got["mean"], (3, 3)), np.eye(3), atol=1e-9)


def test_polarity_sign_flips_and_means_are_spd(spark, sets):
    table = as_table(spark, sets)
    ref = np.eye(4).ravel().tolist()
    signs = []
    for a, b in (("a", "b"), ("b", "a")):
        means = G.state_means(table, ["session_id"], "state", a, b)
        means = means.withColumn("reference", F.array(*[F.lit(v) for v in ref]))
        row = G.polarity(means).collect()[0]
        signs.append(row["sign"])
        assert row["magnitude"] == pytest.approx(abs(row["projection"]))
    assert signs[0] == -signs[1] != 0


def test_projection_equals_numpy(spark, sets):
    means = G.reference_direction(G.state_means(as_table(spark, sets), ["session_id"], "state", "a", "b"))
    row = G.polarity(means).collect()[0]
    ma, mb = fixed_point(sets["a"]), fixed_point(sets["b"])
    pop = fixed_point(np.concatenate([sets["a"], sets["b"]]))
    d = kernels.spd_function(mb, np.log) - kernels.spd_function(ma, np.log)
    w, v = np.linalg.eigh(d)
    top = v[:, np.argmax(np.abs(w))]
    ref = np.outer(top, top)
    want = np.sum((kernels.log_map(pop, mb) - kernels.log_map(pop, ma)) * ref) / np.linalg.norm(ref)
    assert row["projection"] == pytest.approx(want, abs=1e-7)


def test_tiny_reference_is_refused(spark, sets):
    means = G.state_means(as_table(spark, sets), ["session_id"], "state", "a", "b", max_iter=1)
    with pytest.raises(Exception, match="no direction"):
        G.polarity(means.withColumn("reference", F.array_repeat(F.lit(0.0), 16))).collect()


def test_window_counts_centres_and_errors(to_samples):
    m = np.random.default_rng(0).normal(size=(16, 12_500))
    covs = G.covariance_matrices(to_samples(m)).orderBy("win").toPandas()
    assert len(covs) == 50 and covs["center_sec"].iloc[0] == 1.0 and covs["center_sec"].iloc[-1] == 99.0
    checked = G.spd_check(G.covariance_matrices(to_samples(m), overlap=0.5))
    assert checked.count() == 99 and checked.where("not is_spd").count() == 0
    for kw in (dict(overlap=1.0), dict(window_sec=0.2), dict(method="other")):
        with pytest.raises(ValueError):
            G.covariance_matrices(to_samples(m[:, :10]), **kw)


def test_not_spd(spark):
    rows = [("a", 0, [1.0, 2.0, 2.0, 1.0]), ("a", 1, [1.0, 0.5, 0.0, 1.0]), ("a", 2, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "session_id string, win int, cov array<double>")
    assert [r.is_spd for r in G.spd_check(df).orderBy("win").collect()] == [False, False, False]


def test_states_of_windows(spark):
    """Markers at 60, 120 and 180 s give 30 windows of 2 s each, none before the first."""
    markers = spark.createDataFrame(
        [("a", 7500, 151, "eyes_open_1"), ("a", 15000, 152, "eyes_closed"), ("a", 22500, 151, "eyes_open_2")],
        "session_id string, sample_index bigint, marker_id int, label string",
    )
    ends = spark.createDataFrame([("a", 30000)], "session_id string, n_samples bigint")
    windows = spark.createDataFrame([("a", i, 2.0 * i + 1) for i in range(120)], "session_id string, win int, center_sec double")
    out = W.assign_states(windows, W.state_intervals(markers, ends))
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"eyes_open_1": 30, "eyes_closed": 30, "eyes_open_2": 30}
    merged = W.merge_states(out, {"open": ["eyes_open_1", "eyes_open_2", "missing"], "closed": ["eyes_closed"]})
    counts = {r["state_group"]: r["count"] for r in merged.groupBy("state_group").count().collect()}
    assert counts == {"open": 60, "closed": 30}


def test_session_bounds_end_states_but_are_none(spark):
    markers = spark.createDataFrame(
        [("a", 0, 150, "session_start"), ("a", 250, 151, "eyes_open_1"), ("a", 500, 153, "session_end")],
        "session_id string, sample_index bigint, marker_id int, label string",
    )
    ends = spark.createDataFrame([("a", 1251)], "session_id string, n_samples bigint")
    rows = W.state_intervals(markers, ends).collect()
    assert [(r.label, r.onset_sec, r.end_sec) for r in rows] == [("eyes_open_1", 2.0, 4.0)]
    # the report's windows drop session bounds first, so the state runs to the end
    rows = W.report_windows(markers, ends).collect()
    assert [(r.label, r.onset_sec, r.end_sec) for r in rows] == [("eyes_open_1", 2.0, 10.0)]
