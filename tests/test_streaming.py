import numpy as np
import pytest
from conftest import long_frame, matrix_of
from pyspark.sql import functions as F

from encephalake.functions import kernels
from encephalake.operators import quality as Q
from encephalake.schema import SAMPLES
from encephalake.streaming import operators as S
from encephalake.streaming import run, state

KEYS = ["session_id", "channel_idx"]


@pytest.fixture()
def arriving(spark, tmp_path):
    """A stream that delivers a recording in five files, one per micro-batch, in order."""
    m = np.random.default_rng(0).normal(0, 20, size=(2, 1250))
    pdf = long_frame(m)
    import os
    import time

    for i in range(5):
        part = pdf[(pdf.sample_idx >= i * 250) & (pdf.sample_idx < (i + 1) * 250)].sample(frac=1, random_state=i)
        path = f"{tmp_path}/in/part{i}.parquet"
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        part.to_parquet(path, index=False)
        os.utime(path, (time.time() - 100 + i,) * 2)
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return m, S.with_event_time(stream)


def test_stateful_notch_equals_single_shot(arriving):
    m, stream = arriving
    got = matrix_of(run.drain(state.stateful_notch(stream, KEYS)))
    b, a = kernels.notch_biquad(60.0, 30.0, 125.0)
    h = kernels.impulse_response(b, a, 1250)
    np.testing.assert_allclose(got, [np.convolve(x, h)[:1250] for x in m], atol=1e-9)


def test_sliding_quality_equals_batch(arriving, to_samples):
    m, stream = arriving
    got = run.drain(S.sliding_quality(stream, KEYS, n_full=250)).toPandas()
    got["win"] = (got["start_ts"] - got["start_ts"].min()).dt.total_seconds().round().astype(int)
    batch = Q.sliding_quality(to_samples(m)).toPandas().set_index(["channel_idx", "win"])
    assert len(got) >= 2 * 7
    for r in got.itertuples():
        want = batch.loc[(r.channel_idx, r.win)]
        assert (r.std_uv, r.line_ratio, r.status) == pytest.approx((want.std_uv, want.line_ratio, want.status))


def test_last_seconds_keep_only_the_tail(arriving):
    m, stream = arriving
    got = run.drain(state.latest_seconds(stream, KEYS, 4.0)).toPandas()
    last = got.loc[got.groupby("channel_idx")["last_idx"].idxmax()].sort_values("channel_idx")
    np.testing.assert_allclose(np.stack(last["x"].to_list()), m[:, -500:])
    assert got["x"].map(len).max() <= 500


def test_chunks_totals_and_durable_sink(arriving):
    m, stream = arriving
    chunks = run.drain(S.fixed_chunks(stream, KEYS, delay="0 seconds")).toPandas().sort_values(["channel_idx", "chunk_no"])
    assert set(chunks["n"]) == {256} and chunks["chunk_no"].max() >= 2
    for r in chunks.itertuples():
        assert r.mean_uv == pytest.approx(m[r.channel_idx, r.chunk_no * 256 : (r.chunk_no + 1) * 256].mean())
    totals = run.drain_latest(S.running_totals(stream), ["session_id"]).first()
    assert (totals.total, totals.n_samples, totals.elapsed_sec) == (2500, 1250, 10.0)
    np.testing.assert_allclose(matrix_of(run.drain(stream.drop("ts"), partition_by=["session_id"])), m)


def test_failing_consumer_gets_every_row_once(arriving, tmp_path):
    _, stream = arriving
    seen, again, calls = {}, {}, []

    def unsure(batch, batch_id):
        again[batch_id] = batch.count()
        calls.append(batch_id)
        if len(calls) in (2, 3):
            raise ValueError("down")

    ended = run.fan_out(stream, {"sure": lambda b, i: seen.update({i: b.count()}), "unsure": unsure}, f"{tmp_path}/cp")
    assert ended == {"sure": None, "unsure": None}
    assert seen == again == {i: 500 for i in range(5)} and calls == [0, 1, 1, 1, 2, 3, 4]


def test_consumer_that_stays_down_goes_on_later(arriving, tmp_path):
    _, stream = arriving
    seen = {}

    def bad(batch, batch_id):
        raise ValueError("down")

    ended = run.fan_out(stream, {"a": bad}, f"{tmp_path}/cp", attempts=2)
    assert ended["a"] is not None
    assert run.fan_out(stream, {"a": lambda b, i: seen.update({i: b.count()})}, f"{tmp_path}/cp") == {"a": None}
    assert seen == {i: 500 for i in range(5)}


def files_in_order(spark, folder, parts):
    """A stream of one file per micro-batch, in the order given."""
    import os
    import time

    os.makedirs(folder)
    for i, part in enumerate(parts):
        part.to_parquet(f"{folder}/part{i}.parquet", index=False)
        os.utime(f"{folder}/part{i}.parquet", (time.time() - 100 + i,) * 2)
    return S.with_event_time(spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(folder))


def test_late_rows_take_their_places(spark, tmp_path):
    """Batches overlap by up to two seconds and come shuffled; the watermark allows for it."""
    rng = np.random.default_rng(8)
    m = rng.normal(0, 20, size=(2, 1500))
    pdf = long_frame(m)
    arrival = pdf["sample_idx"] + rng.integers(0, 250, len(pdf))
    parts = [pdf[(arrival >= a) & (arrival < a + 250)].sample(frac=1, random_state=a) for a in range(0, 1750, 250)]
    stream = files_in_order(spark, f"{tmp_path}/in", parts)
    b, a = kernels.notch_biquad(60.0, 30.0, 125.0)
    h = kernels.impulse_response(b, a, 1500)
    got = run.drain(state.stateful_notch(stream, KEYS, delay="3 seconds"))
    np.testing.assert_allclose(matrix_of(got), [np.convolve(x, h)[:1500] for x in m], atol=1e-9)
    last = run.drain(state.latest_seconds(stream, KEYS, 4.0, delay="3 seconds")).toPandas()
    final = last.sort_values(["channel_idx", "last_idx", "idx"], key=lambda c: c.map(len) if c.name == "idx" else c).groupby("channel_idx").tail(1)
    assert [list(x) for x in final["idx"]] == [list(range(1000, 1500))] * 2
    np.testing.assert_allclose(np.stack(final["x"].to_list()), m[:, 1000:])


def test_gap_starts_a_new_stretch_once_it_is_final(spark, tmp_path):
    m = np.random.default_rng(2).normal(0, 20, size=(1, 900))
    pdf = long_frame(m)
    parts = [pdf[pdf.sample_idx < 300], pdf[(pdf.sample_idx >= 350) & (pdf.sample_idx < 600)], pdf[pdf.sample_idx >= 600]]
    got = run.drain(state.stateful_notch(files_in_order(spark, f"{tmp_path}/in", parts), KEYS, delay="1 second")).toPandas().sort_values("sample_idx")
    assert got["sample_idx"].tolist() == [*range(300), *range(350, 900)]
    h = kernels.impulse_response(*kernels.notch_biquad(60.0, 30.0, 125.0), 900)
    want = np.concatenate([np.convolve(m[0, :300], h)[:300], np.convolve(m[0, 350:], h)[:550]])
    np.testing.assert_allclose(got["uv"], want, atol=1e-9)


def test_state_ends_after_silence(spark, tmp_path):
    """Session A falls silent; when B has gone on long enough, A's state is gone and A begins anew."""
    a, b = (long_frame(np.ones((1, 250)), name) for name in "AB")
    parts = [a, b]
    for i in range(1, 6):
        more = b.copy()
        more["sample_idx"] += 250 * i
        parts.append(more)
    stream = files_in_order(spark, f"{tmp_path}/in", parts)
    query = run.to_table(state.latest_seconds(stream, KEYS, 1.0, delay="1 second", silence=3.0), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    rows = [p["stateOperators"][0]["customMetrics"] if False else p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) > rows[-1]


def test_block_filter_equals_impulse_response():
    b, a = kernels.notch_biquad(60.0, 30.0, 125.0)
    x = np.random.default_rng(1).normal(size=700)
    block, z, parts = kernels.BlockFilter(b, a, 64), np.zeros(2), []
    for piece in np.split(x, [1, 65, 200, 630]):
        y, z = block.run(piece, z)
        parts.append(y)
    h = kernels.impulse_response(b, a, 700)
    np.testing.assert_allclose(np.concatenate(parts), np.convolve(x, h)[:700], atol=1e-10)


def test_marks_need_no_first_channel(spark, arriving, tmp_path):
    _, stream = arriving
    marks = spark.createDataFrame([("T0", 300, 151, "open"), ("T0", 700, 152, "closed")], "session_id string, sample_idx bigint, marker_id int, label string")
    S.with_event_time(marks).drop("sample_idx").write.parquet(f"{tmp_path}/marks")
    schema = spark.read.parquet(f"{tmp_path}/marks").schema
    got = run.drain(S.insert_markers(stream.where("channel_idx = 1"), spark.readStream.schema(schema).parquet(f"{tmp_path}/marks")))
    assert sorted((r.sample_index, r.marker_id) for r in got.collect()) == [(300, 151), (700, 152)]


def test_markers_take_the_index_of_their_time(spark, arriving, tmp_path):
    _, stream = arriving
    marks = spark.createDataFrame([("T0", 300, 151, "open"), ("T0", 700, 152, "closed")], "session_id string, sample_idx bigint, marker_id int, label string")
    S.with_event_time(marks).drop("sample_idx").write.parquet(f"{tmp_path}/marks")
    schema = spark.read.parquet(f"{tmp_path}/marks").schema
    got = run.drain(S.insert_markers(stream, spark.readStream.schema(schema).parquet(f"{tmp_path}/marks")))
    assert {(r.sample_index, r.marker_id) for r in got.collect()} == {(300, 151), (700, 152)}


def test_feedback_amplitude(spark):
    powers = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0)], "session_id string, alpha double")
    base = spark.createDataFrame([("a", 1.0, False)], "session_id string, base_alpha double, is_control boolean")
    got = sorted(r.amplitude for r in S.feedback(powers, base, ["session_id"]).collect())
    assert got == pytest.approx([0.1, 0.5, 1.0])
    control = base.withColumn("is_control", F.lit(True))
    assert all(np.isnan(r.amplitude) for r in S.feedback(powers, control, ["session_id"]).collect())


@pytest.mark.parametrize("parts", [0, 3])
def test_a_table_is_streamed_as_a_file_or_a_folder(spark, tmp_path, parts):
    import os

    import pandas as pd

    from encephalake.plans.catalog.streams import source

    rows, path = pd.DataFrame({"vec_id": np.arange(12)}), f"{tmp_path}/embeddings.parquet"
    if parts:
        os.makedirs(path)
    for i, part in enumerate(np.array_split(rows, max(parts, 1))):
        part.to_parquet(f"{path}/part-{i:04d}.parquet" if parts else path, index=False)
    got = run.drain(source(spark, str(tmp_path), "embeddings")).toPandas()
    assert sorted(got["vec_id"]) == list(range(12))


@pytest.mark.parametrize("layout", ["file", "parts", "partitioned"])
def test_tables_are_streamed_whole_in_any_layout(spark, tmp_path, layout):
    """One file, a folder of parts and a folder with a partition column give every row, to totals as to a sink."""
    import shutil

    from encephalake.plans.catalog import QUERIES, streams

    given = "/root/testdata/sf0.001/embeddings.parquet"
    rows = spark.read.parquet(given)
    if layout == "file":
        shutil.copyfile(given, f"{tmp_path}/embeddings.parquet")
    elif layout == "parts":
        rows.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    else:
        rows.withColumn("part", F.col("vec_id") % 3).write.partitionBy("part").parquet(f"{tmp_path}/embeddings.parquet")
    got = run.drain(streams.source(spark, str(tmp_path), "embeddings").select("vec_id"))
    assert sorted(r.vec_id for r in got.collect()) == sorted(r.vec_id for r in rows.select("vec_id").collect())
    totals = QUERIES["m6_running_totals"](spark, str(tmp_path))
    assert sum(r.total for r in totals.collect()) == 64 * rows.count()
