import numpy as np

from encephalake.operators import separation as H


def test_points_that_lack_a_channel_come_back_unchanged(spark, to_samples):
    x = np.random.default_rng(3).normal(size=(4, 1200))
    samples = to_samples(x).where("not (sample_idx in (0, 700) and channel_idx = 2)").unionByName(to_samples(x[:3], "T1"))
    matrices = spark.createDataFrame([("T0", (2 * np.eye(4)).ravel().tolist(), [1.0] * 4)], "session_id string, m array<double>, shift array<double>")
    got = H.apply_matrices(samples, matrices, 4).toPandas()
    assert len(got) == samples.count() == 4 * 1200 - 2 + 3 * 1200
    lacks = got.sample_idx.isin([0, 700]) | (got.session_id == "T1")
    assert (got.complete == ~lacks).all()
    before = x[got.channel_idx, got.sample_idx]
    np.testing.assert_allclose(got.uv, np.where(lacks, before, 2 * before + 1))


def test_remove_components_returns_every_sample(spark):
    from encephalake.plans import views
    from encephalake.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["h3_remove_components"](spark, sf).cache()
    assert got.count() == views.samples(spark, sf).count()
    assert 0 < got.where("not complete").count() < got.count()
