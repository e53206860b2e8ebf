"""Phase in bounded memory: samples meet as short chunks, long stretches as slabs and tiles."""

import re

import numpy as np
import pytest

from encephalake.functions.layout import chunk_arrays, gapless
from encephalake.operators import signal as C
from encephalake.operators.longphase import split_phase, with_stretches

KEYS = ["session_id", "channel_idx"]
SCHEMA = "session_id string, channel_idx int, sample_idx long, uv double"


def rows_of(spark, places, values, channel=0):
    return spark.createDataFrame([("T0", channel, int(i), v if v is None else float(v)) for i, v in zip(places, values)], SCHEMA)


def expected(places, values):
    """(channel's index, phase) of each run of sorted rows, transformed on its own."""
    at, v = np.asarray(places), np.asarray(values, float)
    return sorted((int(i), float(b)) for part in gapless(at) for i, b in zip(at[part], np.angle(C.analytic(v[part])) % (2 * np.pi)))


def assert_same(df, want):
    got = sorted((r.sample_idx, r.b) for r in df.collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    np.testing.assert_allclose(np.exp(1j * np.array([b for _, b in got])), np.exp(1j * np.array([b for _, b in want])), atol=1e-9)


def split(samples, area, length=64):
    return split_phase(with_stretches(chunk_arrays(samples, length, keys=KEYS, positions=True), KEYS), KEYS, area)


@pytest.mark.parametrize("area", [16, 64, 1 << 17])
def test_slabs_and_tiles_of_any_size(spark, area):
    places = [*range(37, 1337), *range(1340, 1341), *range(1500, 1509), *range(1600, 2377)]
    values = np.random.default_rng(7).normal(size=len(places))
    assert_same(split(rows_of(spark, places, values), area), expected(places, values))


@pytest.mark.parametrize("piece", [10, 1 << 20])
def test_repeated_rows_end_a_stretch(spark, piece):
    """A place that comes twice ends a stretch and begins the next one, however long the key; also a stretch's first place."""
    places = sorted([*range(0, 300), *range(310, 500), 0, 100, 100, 310, 311, 499])
    values = np.sin(np.asarray(places) * 0.7) + np.asarray(places) % 5
    got = C.instantaneous_phase(rows_of(spark, places, values), piece=piece, length=64)
    turn = lambda pairs: np.array(sorted((i, round(np.cos(b), 6), round(np.sin(b), 6)) for i, b in pairs))
    assert np.allclose(turn((r.sample_idx, r.b) for r in got.collect()), turn(expected(places, values)), atol=2e-6)


@pytest.mark.parametrize("piece", [10, 1 << 20])
def test_a_null_sample_leaves_its_stretch_without_phase(spark, piece):
    places, values = [*range(200), *range(210, 400)], [*np.cos(np.arange(390) * 0.3)]
    values[50] = None
    got = {r.sample_idx: r.b for r in C.instantaneous_phase(rows_of(spark, places, values), piece=piece, length=64).collect()}
    assert {i for i, b in got.items() if b is None} == {*range(200)} and {*got} == {*places}


def test_rows_without_key_or_place_have_no_phase(spark):
    whole = rows_of(spark, range(100), np.arange(100) % 7)
    odd = spark.createDataFrame([(None, 0, 5, 1.0), ("T0", None, 5, 1.0), ("T0", 0, None, 1.0)], SCHEMA)
    assert C.instantaneous_phase(whole.unionByName(odd)).count() == 100


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_a_key_may_come_in_many_batches(spark, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    values = np.random.default_rng(3).normal(size=(3, 700))
    samples = rows_of(spark, range(700), values[0], 0).unionByName(rows_of(spark, range(5, 705), values[1], 1)).unionByName(rows_of(spark, range(700), values[2], 2))
    try:
        spark.conf.set(name, str(batch))
        got = C.instantaneous_phase(samples, length=64).cache()
        got.count()
    finally:
        spark.conf.set(name, before)
    for c, first in ((0, 0), (1, 5), (2, 0)):
        assert_same(got.where(f"channel_idx = {c}"), expected(np.arange(first, first + 700), values[c]))
    got.unpersist()


def test_no_group_of_rows_holds_a_channel(spark, to_samples, synthetic):
    """Samples are collected by chunk only: a group of all of a key's rows took an executor's memory."""
    phase = C.instantaneous_phase(to_samples(synthetic[:2, :300]))
    plan = phase._jdf.queryExecution().optimizedPlan().toString()
    collected = [x for x in plan.splitlines() if re.search(r"Aggregate .*collect_list", x)]
    assert collected and all("chunk" in re.search(r"Aggregate \[(.*?)\]", x).group(1) for x in collected)


def test_dynamics_of_a_crop_collect_samples_by_chunk_only(spark, to_samples, synthetic):
    plan = C.extract_dynamics(to_samples(synthetic[:2, :300]).where("sample_idx >= 100"))._jdf.queryExecution().optimizedPlan().toString()
    collected = [x for x in plan.splitlines() if re.search(r"Aggregate .*collect_list\(struct\(p, ", x)]
    assert collected and all("chunk" in re.search(r"Aggregate \[(.*?)\]", x).group(1) for x in collected)
    assert not re.search(r"explode\(arrays_zip\((p|y|r)\b", plan)
