"""The corpus pipeline against brute force on a small table, and its odd rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from encephalake.llm import language_id, packing, quality_classifier
from encephalake.llm import stages as stages_of
from encephalake.llm.common import BATCH_BYTES, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    # names that the operators use themselves, and rows without an id or a text
    docs = docs.withColumn("selected", F.lit("s")).withColumn("mark", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("c0", F.lit(3)).withColumn("lang_pred", F.lit("z"))
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(8).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    seen = [written(docs, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), "stage"))
    return seen


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns_stay(stages):
    for found in stages[1:-1]:
        assert found.columns == stages[0].columns


def test_trained_stages(spark, stages):
    docs, good, known = stages[:3]
    model = quality_classifier.train(docs, spark.read.parquet(SF + "/labels.parquet"))
    features = quality_classifier.Features()

    def selected(text):
        slots, values = features.of((text or "").encode())
        tail = model.tails((model.weights[slots] @ values)[None])[0, quality_classifier.TARGET - 1] if len(slots) else 0
        return tail >= quality_classifier.CUTOFF

    assert rows(good) == [r for r in rows(docs) if selected(r[1])]
    assert 0 < good.count() < docs.count()
    model = language_id.train(good.where(~language_id.held_out()))
    assert rows(known) == [r for r in rows(good) if re.search(r"[^\W\d_]", r[1])]


def test_exact_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    normal = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in before]
    want = {}
    for r, n in zip(before, normal):
        order = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        want[n] = min(want.get(n, (order, r)), (order, r), key=lambda x: x[0])
    assert sorted((repr((r[0], len(r[1]))) for _, r in want.values())) == sorted(repr((r[0], len(r[1]))) for r in after)


def test_near_stage(stages):
    from test_near_copies import plain_kept

    before, after = rows(stages[3]), rows(stages[4])
    named = [r[:2] for r in before if r[0] is not None]
    assert plain_kept(named) == sorted(r[0] for r in after if r[0] is not None)
    assert len(after) < len(before)


def test_packing_stage(stages):
    kept = stages[4].count()
    packed = stages[5].toPandas()
    assert packed[packed.piece == 0].shape[0] == kept and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_near_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(300))
    data = [(3, text, "en"), (2, text.replace("word7 ", "word8 "), "en"), (None, text.replace("word9 ", "x "), "en"), (3, "quite another text", "en"), (3, "and one more", "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.text) for r in stages_of.near(spark, docs, SF).collect())
    # 3, 2 and the row without an id are one component by five-word shingles: the smallest id stays
    assert got == [(2, data[1][1]), (3, "and one more"), (3, "quite another text")]


def test_rows_that_share_id_and_text(spark):
    data = [(1, "a b", "en"), (1, "ab", "en"), (1, "a b", "en"), (2, "ab", "en"), (None, "n", "en"), (None, "n", "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert rows(stages_of.exact(spark, docs, SF)) == [(1, "a b", "en"), (None, "n", "en")]


def test_empty_table(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_workers_get_small_batches(spark):
    """Long texts do not make long batches: a worker's memory is bounded by bytes, not by rows."""
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab cd ', 100000)").alias("text"), F.lit("x").alias("lang"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    try:
        spark.conf.set(name, "64m")
        plain, _ = stages_of._plain(docs)
        found = plain.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 40
        assert max(r["size"] for r in found) <= BATCH_BYTES + 1_000_000
        spark.conf.set(name, "1m")
        stages_of._plain(docs)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_packing_at_once(spark):
    """However little text is encoded at once and few words are known, the pieces are the same."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(SF + "/documents.parquet")
    file = public_tokenizers.path("byte_bpe_50k.json")
    every = [rows(packing.pieces(docs, file, **how)) for how in ({}, {"known": 1000, "at_once": 10_000})]
    assert every[0] == every[1]
