import numpy as np
import pytest
from conftest import matrix_of

from encephalake.operators import separation as H


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(0)
    t = np.arange(6000) / 125
    sources = np.stack([np.sign(np.sin(2 * np.pi * 1.3 * t)), rng.laplace(size=6000), ((t * 2.1) % 1) - 0.5, rng.uniform(-1, 1, 6000)])
    return sources, rng.normal(size=(4, 4)), t


@pytest.mark.parametrize("limit", [1024, 0])
def test_sources_are_separated(to_samples, mixed, limit):
    sources, mixing, _ = mixed
    its = 60 if limit else 6
    ica = H.fit_ica(to_samples(mixing @ sources), 4, 4, max_iter=its, max_driver_keys=limit).collect()[0]
    unmixed = np.reshape(ica["unmixing"], (4, 4)) @ (mixing @ sources)
    corr = np.abs(np.corrcoef(np.vstack([unmixed, sources]))[:4, 4:])
    if limit:
        assert (corr.max(axis=0) > 0.95).all()
    assert np.allclose(np.reshape(ica["mixing"], (4, 4)) @ np.reshape(ica["unmixing"], (4, 4)), np.eye(4))


def test_no_exclusion_reconstructs_the_input(spark, to_samples, mixed):
    sources, mixing, _ = mixed
    samples = to_samples(mixing @ sources[:, :1000])
    ica = H.fit_ica(samples, 4, 4, max_iter=3)
    none = spark.createDataFrame([], "session_id string, component int")
    out = H.apply_matrices(samples, H.cleaning_matrices(ica, none, 4), 4)
    np.testing.assert_allclose(matrix_of(out), mixing @ sources[:, :1000], atol=1e-9)


def test_removing_a_component_removes_its_part_only(spark, to_samples, mixed):
    sources, mixing, _ = mixed
    x = mixing @ sources
    ica = H.fit_ica(to_samples(x), 4, 4)
    row = ica.collect()[0]
    un, mix, mean = np.reshape(row["unmixing"], (4, 4)), np.reshape(row["mixing"], (4, 4)), np.array(row["mean"])
    gone = spark.createDataFrame([("T0", 1)], "session_id string, component int")
    got = matrix_of(H.apply_matrices(to_samples(x), H.cleaning_matrices(ica, gone, 4), 4))
    want = x - np.outer(mix[:, 1], un[1] @ (x - mean[:, None]))
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_blink_component_is_flagged(to_samples):
    rng = np.random.default_rng(1)
    n = 8000
    blink = np.zeros(n)
    for at in range(200, n, 400):
        blink[at : at + 40] += np.hanning(40) * 100
    x = rng.laplace(size=(16, 16)) @ rng.laplace(size=(16, n)) * 0.5
    x[0] += blink
    x[1] += blink * 0.9
    ica = H.fit_ica(to_samples(x), 16, 16)
    scores = H.flag_eye_components(to_samples(x), ica).toPandas()
    assert scores.loc[scores["score"].abs().idxmax(), "flagged"]
    assert scores["flagged"].sum() <= 2


def test_a_round_works_on_slices_and_blocks_are_short(spark, to_samples):
    from encephalake.functions.iterate import SLICE, fixed_point
    from encephalake.operators.separation import sample_blocks

    rows = spark.range(1000).coalesce(1).selectExpr("'T0' session_id", "array(double(id)) x")
    start = spark.createDataFrame([("T0", [0.0, 0.0])], "session_id string, s array<double>")

    def contribute(rows, s):
        return np.array([len(rows) > SLICE, np.sum(rows)], float)

    s = fixed_point(rows, ["session_id"], "x", start, contribute, lambda total, n, s: (np.append(total, n)[-3:], True), 1).first()["s"]
    assert s == [0.0, 499500.0, 1000.0]
    blocks = sample_blocks(to_samples(np.random.default_rng(0).normal(size=(16, 1000))))
    assert blocks.selectExpr("max(size(x))").first()[0] * 10_000 * 8 < 64e6
