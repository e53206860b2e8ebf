"""End-to-end chains: recordings to encodings, and the two classifiers compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import SAMPLE_RATE, SUBSETS
from ..functions.expr import channel_name
from ..operators import evaluate, features, fidelity
from ..operators.signal import extract_dynamics, preprocess
from ..operators.windows import equal_segments, midpoint_rows
from ..session import materialise


def encode_recordings(samples: DataFrame, solver: str = "euler", fs: float = SAMPLE_RATE) -> DataFrame:
    """Filtered samples to (session_id, channel_idx, channel, sample_idx, a, b, c), in microvolts throughout.

    Filtered samples feed the envelope and the phase, so they are written once.
    """
    clean = materialise(preprocess(samples, fs=fs), "filtered")
    return extract_dynamics(clean, solver, fs).withColumn("channel", channel_name(F.col("channel_idx")))


def evaluate_methods(
    samples: DataFrame,
    labels: DataFrame,
    encoding: DataFrame,
    subset: str = "4",
    trees: int = 100,
    depth: int = 6,
    order: Sequence[Column] = (),
    minimum: int = 10,
) -> DataFrame:
    """One row per method: template similarity against boosted trees, then compared.

    ``labels`` is (session_id, seg, label) with -1 for transitions; classes other
    than 0 count as class 1 for the templates.  ``encoding`` has a value per sample
    and channel; each segment is represented by the value at its middle.
    """
    valid = evaluate.valid_segments(labels, ["session_id"], minimum=minimum)
    keys = ["session_id", "channel", "seg", "label"]
    cut = equal_segments(samples, labels, ["session_id", "channel", "channel_idx"])
    cut = cut.join(valid.select("session_id", "seg"), ["session_id", "seg"], "left_semi")
    spans = cut.withColumnRenamed("seg_len", "span_len")

    rows = features.channel_features(spans, keys)
    names = features.feature_names()
    split = materialise(evaluate.stratified_split(rows, "label", ["session_id", "channel", "seg"]), "split")
    model = evaluate.train_boosted_trees(split.where(~F.col("is_test")), names, trees=trees, depth=depth)
    scored = evaluate.predict(model, split.where("is_test")).withColumnRenamed("label", "truth")
    classical = _result(scored, "classical", len(names))

    shape = cut.groupBy("session_id", "seg").agg(
        F.min("sample_idx").alias("start_idx"), F.max("seg_len").alias("seg_len")
    )
    wanted = encoding.where(F.col("channel").isin(SUBSETS[subset]))
    middles = midpoint_rows(wanted, shape)
    states = fidelity.segment_states(middles, ["session_id", "seg"], len(SUBSETS[subset]))
    cls = F.when(F.col("label") == 0, 0).otherwise(1).alias("label")
    tagged = states.join(valid.select("session_id", "seg", cls), ["session_id", "seg"])
    parts = materialise(
        evaluate.ordered_split(tagged, ["session_id"], F.expr("seg div 1024"), list(order) or [F.col("seg")]), "states"
    )
    templates = fidelity.build_templates(parts.where("is_train"), ["label"], ["session_id", "seg"])
    test = parts.where(~F.col("is_train"))
    scores = fidelity.template_fidelity(test, templates, ["session_id", "seg"])
    ones = scores.where("label = 1").select("session_id", "seg", F.col("fidelity").alias("score"))
    best = (
        fidelity.classify(scores, ["session_id", "seg"])
        .join(ones, ["session_id", "seg"])
        .join(test.select("session_id", "seg", F.col("label").alias("truth")), ["session_id", "seg"])
    )
    return classical.unionByName(_result(best, "template", 3 * len(SUBSETS[subset])))


def _result(scored: DataFrame, method: str, n_features: int) -> DataFrame:
    tagged = scored.withColumn("method", F.lit(method))
    metrics = evaluate.classification_metrics(tagged, ["method"])
    auc = evaluate.auc_table(tagged, ["method"]).select("method", "auc")
    return metrics.join(auc, "method").withColumn("n_features", F.lit(n_features))


def compare(results: DataFrame) -> DataFrame:
    return evaluate.compare_methods(results.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
