import json

import numpy as np
import pytest
from conftest import matrix_of
from pyspark.sql import functions as F

from encephalake.dims import CHANNEL_NAMES
from encephalake.operators import project as P
from encephalake.sources import array_folders, encodings, logs, recordings, sessions


def test_array_folders_become_samples(spark, tmp_path):
    rng = np.random.default_rng(0)
    boards = {}
    for name in ("r1", "r2"):
        folder = tmp_path / name
        folder.mkdir()
        boards[name] = rng.normal(size=(5, 300))
        np.save(folder / "raw_data.npy", boards[name])
        meta = {
            "session_id": f"sess_{name}", "board_id": 2, "sample_rate": 125, "eeg_channel_indices": [1, 3],
            "channel_names": ["Fp1", "Fp2"], "total_channels": 5, "total_samples": 300, "duration_sec": 2.4,
            "recorded_at": "2026-01-01T00:00:00",
        }
        (folder / "metadata.json").write_text(json.dumps(meta, indent=2))
    df = recordings.import_array_folders(spark, f"{tmp_path}/*", task_bytes=2048)
    for name, m in boards.items():
        np.testing.assert_array_equal(matrix_of(df.where(F.col("session_id") == f"sess_{name}")), m[[1, 3]])
    assert {r.channel for r in df.select("channel").distinct().collect()} == {"Fp1", "Fp2"}


def test_append_then_read_prunes_sessions(spark, to_samples, tmp_path):
    root = str(tmp_path)
    m = np.arange(20.0).reshape(2, 10)
    recordings.append(to_samples(m, "A"), root, "samples")
    recordings.append(to_samples(m * 2, "B"), root, "samples")
    back = recordings.read_table(spark, root, "samples")
    np.testing.assert_array_equal(matrix_of(back.where("session_id = 'B'")), m * 2)
    plan = back.where("session_id = 'B'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_id" in plan


def test_percent_header_csv(spark, tmp_path):
    lines = ["%OpenExport", "%Sample Rate = 125 Hz", "0, 1.5, 2.5", "1, -1.0, 0.25"]
    (tmp_path / "rec.csv").write_text("\n".join(lines))
    out = recordings.read_percent_csv(spark, f"{tmp_path}/rec.csv", 2)
    assert {(r.session_id, r.channel_idx, r.sample_idx, r.uv) for r in out.collect()} == {
        ("rec", 0, 0, 1.5), ("rec", 1, 0, 2.5), ("rec", 0, 1, -1.0), ("rec", 1, 1, 0.25)
    }


def test_quality_log_line_format_and_incomplete_lines(spark):
    entry = "  {:4s} r={:4.0f} s={:6.1f} l={:3.0f}%"
    full = "[sq] t=   1.0" + "".join(entry.format(c, 3, 12.3 + i, 20) for i, c in enumerate(CHANNEL_NAMES))
    rows = [("a", full), ("a", full.replace("t=   1.0", "t=   2.0").replace("  Cz ", "  Xx ")), ("a", "noise")]
    out = logs.parse_quality_lines(spark.createDataFrame(rows, "session_id string, value string"), CHANNEL_NAMES)
    assert out.count() == 16 and {r.t for r in out.collect()} == {1.0}
    first = out.where("channel = 'Fp1'").first()
    assert (first.rail_pct, first.std_uv, first.line_ratio, first.status) == (3.0, 12.3, 0.2, 0)


def test_written_log_lines_parse_back(spark):
    rows = [("a", 0, c, i, 1.0, 10.0 + i, 0.5) for i, c in enumerate(CHANNEL_NAMES)]
    q = spark.createDataFrame(rows, "session_id string, win bigint, channel string, channel_idx int, rail_pct double, std_uv double, line_ratio double")
    line = logs.quality_lines(q).first()["value"]
    assert line.startswith("[sq] t=   1.0  Fp1  r=   1 s=  10.0 l= 50%")


def test_encoding_and_document(spark, tmp_path):
    rows = [("s", c, i, 0.1 * i, 1.0, 0.5) for c in ("Fp1", "Cz") for i in range(5)]
    pn = spark.createDataFrame(rows, "session_id string, channel string, sample_idx bigint, a double, b double, c double")
    encodings.save_encoding(pn, f"{tmp_path}/pn")
    back = encodings.load_encoding(spark, f"{tmp_path}/pn")
    assert sorted(map(tuple, back.select(pn.columns).collect())) == sorted(map(tuple, pn.collect()))
    doc = json.loads(encodings.interchange_documents(pn, "S007", config={"lambda_a": 0.1, "solver": "euler"}, with_timestamps=True).first()["document"])
    assert doc["metadata"]["subject_id"] == "S007" and doc["metadata"]["n_samples"] == 5
    assert doc["metadata"]["pn_config"]["lambda_a"] == 0.1
    assert doc["pn_parameters"]["Fp1"]["a"] == pytest.approx([0, 0.1, 0.2, 0.3, 0.4])
    assert doc["timestamps"] == pytest.approx([0, 0.008, 0.016, 0.024, 0.032])
    assert encodings.interchange_documents(pn, piece=2).count() == 3
    at = P.at_index(back, 2, ["Cz"]).collect()
    assert len(at) == 1 and at[0].a == pytest.approx(0.2)


def test_registry(spark, to_samples, tmp_path):
    m = np.ones((3, 250))
    reg = sessions.register(to_samples(m, "A"), "S1", "oddball", attrs={"k": "v"}).unionByName(
        sessions.register(to_samples(m, "B"), "S1")
    )
    recordings.append(reg, str(tmp_path), "sessions")
    back = recordings.read_table(spark, str(tmp_path), "sessions")
    row = sessions.query_sessions(back, "S1", "oddball").collect()
    assert len(row) == 1 and row[0].duration_sec == 2.0 and row[0].status == "recorded" and row[0].attrs == {"k": "v"}
    assert row[0].channel_names == ["Fp1", "Fp2", "F3"] and row[0].created_at is not None
    assert sessions.list_sessions(back, "S1").count() == 2


def test_provenance(spark):
    comp = spark.createDataFrame([("A", 3, "eye blink"), ("A", 1, "line noise")], "session_id string, component int, label string")
    base = spark.createDataFrame([("A", {"k": "v", "ica_source": "old"}), ("B", None)], "session_id string, attrs map<string,string>")
    got = {r.session_id: r.attrs for r in recordings.provenance(base, comp, "raw.parquet").collect()}
    assert got["A"] == {"k": "v", "ica_applied": "true", "ica_source": "raw.parquet", "ica_n_excluded": "2", "ica_excluded_labels": "line noise,eye blink"}
    assert got["B"]["ica_n_excluded"] == "0" and got["B"]["ica_excluded_labels"] == ""


# ---------------------------------------------------------------- array folders


@pytest.fixture()
def folders(spark, to_samples, tmp_path):
    """Two sessions written in parts of 100 samples; one starts at 250, lacks samples and has board times."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(3, 450)), rng.normal(size=(2, 120))
    whole = to_samples(a, "A").where("not (channel_idx = 1 and sample_idx between 110 and 130)").withColumn("sample_idx", F.col("sample_idx") + 250)
    rows = whole.unionByName(to_samples(b, "B")).withColumn("t_sec", F.col("sample_idx") / 100 + 7)
    done = array_folders.write(rows, f"{tmp_path}/out", part=100).collect()
    assert len(done) == 5 + 1 + 1
    return rows, f"{tmp_path}/out"


def as_rows(df):
    return sorted(tuple(r) for r in df.select("session_id", "channel", "channel_idx", "sample_idx", "uv", "t_sec").collect())


@pytest.mark.parametrize("task_bytes", [256, 5000, 1 << 20])
def test_written_folders_are_read_back(spark, folders, task_bytes):
    rows, root = folders
    assert as_rows(array_folders.read(spark, root, taskBytes=str(task_bytes))) == as_rows(rows)


def test_filters_reach_the_files(spark, folders):
    rows, root = folders
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = "session_id = 'A' and channel in ('Fp1', 'F3') and sample_idx >= 390 and sample_idx < 512"
    df = array_folders.read(spark, root).where(wanted)
    assert as_rows(df) == as_rows(rows.where(wanted)) and df.count() == 2 * 122
    assert "Filter (" not in df._jdf.queryExecution().executedPlan().toString()
    assert array_folders.read(spark, root).where("channel_idx = 9").count() == 0


def test_an_array_without_metadata_is_not_read(spark, folders):
    import pathlib

    rows, root = folders
    np.save(pathlib.Path(root) / "A" / "part-000002" / "raw_data-lost.npy", np.ones((3, 9)))
    (pathlib.Path(root) / "A" / "part-000099").mkdir()
    np.save(pathlib.Path(root) / "A" / "part-000099" / "raw_data-lost.npy", np.ones((3, 9)))
    assert as_rows(array_folders.read(spark, root)) == as_rows(rows)


def test_schema_without_board_time(spark, to_samples, tmp_path):
    array_folders.write(to_samples(np.ones((1, 10))), str(tmp_path)).collect()
    assert "t_sec" not in array_folders.read(spark, str(tmp_path)).columns
    assert recordings.import_array_folders(spark, str(tmp_path)).where("t_sec is null").count() == 10


# ---------------------------------------------------------------- board time and versions


def test_board_time_is_as_of(spark, to_samples):
    samples = to_samples(np.zeros((2, 50))).drop("t_sec")
    stored = {5: 1.0, 6: 1.02, 20: 3.5, 44: 9.0}
    times = spark.createDataFrame([("T0", i, t) for i, t in stored.items()] + [("T0", 30, None), ("X", 1, 5.0)], "session_id string, sample_idx bigint, board_sec double")
    got = recordings.board_time(samples, times, bucket=8).collect()
    assert len(got) == 100
    for r in got:
        before = [i for i in stored if i <= r.sample_idx]
        want = stored[max(before)] + (r.sample_idx - max(before)) / 125 if before else r.sample_idx / 125
        assert r.t_sec == pytest.approx(want)


def session_tables(spark, samples, ids):
    sess = spark.createDataFrame([(i, {"k": i}) for i in ids], "session_id string, attrs map<string,string>")
    marks = spark.createDataFrame([(i, 3, 150, "open") for i in ids], "session_id string, sample_index bigint, marker_id int, label string")
    feed = spark.createDataFrame([(i, 0.5, 1.0) for i in ids], "session_id string, t_sec double, state float")
    return {"sessions": sess, "samples": samples, "markers": marks, "feedback": feed}


@pytest.fixture()
def store(spark, to_samples, tmp_path):
    root = f"{tmp_path}/store"
    both = to_samples(np.ones((2, 10)), "A").unionByName(to_samples(np.ones((2, 20)) * 2, "B")).withColumn("t_sec", F.col("sample_idx") * 1.5)
    recordings.write_version(spark, root, session_tables(spark, both, "AB"))
    return root


def test_cleaned_session_replaces_its_rows_only(spark, to_samples, store):
    comp = spark.createDataFrame([("A", 3, "eye blink")], "session_id string, component int, label string")
    recordings.save_cleaned(spark, store, to_samples(np.ones((2, 10)) * 5, "A").drop("t_sec"), comp, "raw")
    samples, markers = recordings.read_session(spark, store)
    assert {(r.session_id, r.uv) for r in samples.select("session_id", "uv").distinct().collect()} == {("A", 5.0), ("B", 2.0)}
    assert samples.where("t_sec = sample_idx * 1.5").count() == samples.count() == 60  # stored times are carried on
    assert markers.count() == 2 and recordings.read_version(spark, store, "feedback").count() == 2
    attrs = {r.session_id: r.attrs for r in recordings.read_version(spark, store, "sessions").collect()}
    assert attrs["A"]["ica_excluded_labels"] == "eye blink" and attrs["A"]["k"] == "A" and attrs["B"] == {"k": "B"}


@pytest.mark.parametrize("dies_at", ["samples", "markers", "feedback", "sessions"])
def test_half_written_version_is_never_seen(spark, to_samples, store, monkeypatch, dies_at):
    real = recordings._write

    def dying(df, path, name, mode):
        if name == dies_at:
            raise OSError("lost")
        real(df, path, name, mode)

    monkeypatch.setattr(recordings, "_write", dying)
    with pytest.raises(OSError):
        comp = spark.createDataFrame([], "session_id string, component int, label string")
        recordings.save_cleaned(spark, store, to_samples(np.ones((2, 10)) * 5, "A").drop("t_sec"), comp, "raw")
    assert recordings.versions(spark, store).count() == 1
    assert {r.uv for r in recordings.read_version(spark, store, "samples").collect()} == {1.0, 2.0}
    assert all("ica_applied" not in r.attrs for r in recordings.read_version(spark, store, "sessions").collect())


def test_equal_names_of_two_folders_stay_apart(spark, tmp_path):
    for folder, value in (("x", 1.0), ("y", 2.0)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "rec.csv").write_text("%head\n0, " + str(value) + "\n1, bad\n2, 3.0\n")
    out = recordings.read_percent_csv(spark, f"{tmp_path}/*/rec.csv", 1)
    got = sorted((r.file.split("/")[-2], r.session_id, r.sample_idx, r.uv) for r in out.collect() if r.uv is not None)
    assert got == [("x", "rec", 0, 1.0), ("x", "rec", 2, 3.0), ("y", "rec", 0, 2.0), ("y", "rec", 2, 3.0)] and out.count() == 6
