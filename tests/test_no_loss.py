"""Rows with missing keys, cells or features stay."""

import numpy as np
from pyspark.sql import functions as F

from encephalake.functions.iterate import matrix_sums
from encephalake.operators import evaluate
from encephalake.sources import recordings


def test_null_keys_are_summed(spark):
    rows = [("a", [1.0, 2.0]), (None, [3.0, 4.0]), (None, [5.0, 6.0])]
    got = {r.k: (r.n, list(r.total)) for r in matrix_sums(spark.createDataFrame(rows, "k string, v array<double>"), ["k"], "v").collect()}
    assert got == {"a": (1, [1.0, 2.0]), None: (2, [8.0, 10.0])}


def test_bad_cell_leaves_the_line(spark, tmp_path):
    lines = ["% a header", *[f"{i}, {i}.5, {i + 100}" for i in range(6)]]
    lines[3] = "2, broken, 102"
    (tmp_path / "rec.csv").write_text("\n".join(lines))
    got = recordings.read_percent_csv(spark, str(tmp_path), n_channels=2).toPandas()
    by = {(r.channel_idx, r.sample_idx): r.uv for r in got.itertuples()}
    assert len(by) == 12 and np.isnan(by[0, 2]) and by[1, 2] == 102 and by[0, 5] == 5.5


def test_folders_of_one_name_stay_apart(spark, tmp_path):
    import json

    for n, subject in enumerate(("subj1", "subj2")):
        folder = tmp_path / subject / "ses1"
        folder.mkdir(parents=True)
        np.save(folder / "raw_data.npy", np.full((2, 20), float(n)))
        (folder / "metadata.json").write_text(json.dumps({"session_id": subject, "eeg_channel_indices": [0, 1], "channel_names": ["A", "B"]}))
    got = recordings.import_array_folders(spark, f"{tmp_path}/*/*").groupBy("session_id").agg(F.count("*").alias("n"), F.max("uv").alias("x")).collect()
    assert {(r.session_id, r.n, r.x) for r in got} == {("subj1", 40, 0.0), ("subj2", 40, 1.0)}


def test_missing_features_are_filled(spark):
    rows = [(i, float(i % 2), None if i % 7 == 0 else float(i % 2) + 0.01 * i, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, y double, label int")
    model = evaluate.train_boosted_trees(df, ["x", "y"], trees=2, depth=2)
    got = evaluate.predict(model, df)
    assert got.count() == 60 and set(got.columns) == {"id", "x", "y", "label", "prediction", "score"}
