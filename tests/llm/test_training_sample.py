"""The classifier's training sample: one row per id, gathered after the scan."""

from __future__ import annotations

import numpy as np

from encephalake.llm import quality_classifier

SF = "/root/testdata/sf0.001"


def test_repeated_id_counts_once(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(SF + "/labels.parquet")
    hot = labels.join(docs, "doc_id").orderBy("doc_id").first()
    repeated = docs.unionByName(spark.range(500).selectExpr(f"{hot.doc_id}L as doc_id").join(docs.where(f"doc_id = {hot.doc_id}"), "doc_id"))
    sample = quality_classifier.training_sample(repeated, labels)
    keys = [r._key for r in sample.collect()]
    assert len(keys) == len(set(keys)) == labels.join(docs, "doc_id").select("doc_id").distinct().count()
    one, many = quality_classifier.train(docs, labels), quality_classifier.train(repeated, labels)
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.thresholds, many.thresholds)


def test_several_texts_of_an_id_give_one_row_in_any_order(spark):
    rows = [(1, f"text {i}") for i in range(20)] + [(2, "b"), (None, "c"), (3, None)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    found = [sorted(quality_classifier.training_sample(spark.createDataFrame(r, "doc_id long, text string"), labels).collect()) for r in (rows, rows[::-1])]
    assert found[0] == found[1] and [r._key for r in found[0]] == [1, 2]


def test_scan_is_not_gathered_before_the_join(spark):
    docs, labels = spark.read.parquet(SF + "/documents.parquet"), spark.read.parquet(SF + "/labels.parquet")
    sample = quality_classifier.training_sample(docs.repartition(6), labels)
    assert sample.rdd.getNumPartitions() == 1
    assert "Coalesce" not in sample._jdf.queryExecution().executedPlan().toString()


def test_language_sample_has_one_row_an_id(spark, monkeypatch):
    """An id with most of the rows is one of the sampled documents, not all of them."""
    from encephalake.llm import language_id

    monkeypatch.setattr(language_id, "PER_LANGUAGE", 40)
    rows = [(5, f"Q number {i}", "en") for i in range(600)] + [(5, "Q number 1", "en")] * 50 + [(i, f"text {i}", "en") for i in range(100, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = language_id.gram_counts(docs).where("context = 0").toPandas().set_index("gram").n
    assert counts[ord("Q")] == 1 and counts[ord("x")] == 20
    assert len(language_id.build(language_id.gram_counts(docs)).languages) == 1


def test_partial_language_counts_follow_the_sample(spark):
    """However many partitions a shuffle has, the sample is counted by as many tasks as its size asks for."""
    from encephalake.llm import language_id

    docs = spark.createDataFrame([(i, f"text {i}", "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("50", "false")):
            spark.conf.set(name, value)
        many = language_id.gram_counts(docs)
        many.collect()
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "Coalesce 1" in plan
        assert many.where("context = 0").groupBy("lang").agg({"n": "sum"}).count() == 2
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
