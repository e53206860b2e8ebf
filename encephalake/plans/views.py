"""The given tables seen as recordings, markers and scores.

Each view has a Spark form (a function of the session and the table folder) and
the same definition as SQL text, kept side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CHANNEL_NAMES
from ..functions.expr import channel_name, micros_of
from ..functions.layout import numbered

_NAMES_SQL = "[" + ",".join(f"'{n}'" for n in CHANNEL_NAMES) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_embeddings(vectors: DataFrame) -> DataFrame:
    """16 consecutive vectors are one block of 64 samples of a 16-channel recording."""
    blk = F.expr("vec_id div 16")
    return vectors.select(
        F.concat(F.lit("S"), blk % 2).alias("session_id"),
        (F.col("vec_id") % 16).cast("int").alias("channel_idx"),
        (F.expr("(vec_id div 32) * 64")).alias("base"),
        F.posexplode("embedding").alias("pos", "x"),
    ).select(
        "session_id",
        channel_name(F.col("channel_idx")).alias("channel"),
        "channel_idx",
        (F.col("base") + F.col("pos")).alias("sample_idx"),
        (F.lit(100.0) * (1 + F.col("channel_idx") % 8) * F.col("x").cast("double")).alias("uv"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


S_SQL = f"""s as (
  select 'S' || ((vec_id // 16) % 2) session_id, {_NAMES_SQL}[(vec_id % 16)::int + 1] channel,
         (vec_id % 16)::int channel_idx, (vec_id // 32) * 64 + pos sample_idx,
         100.0::double * (1 + (vec_id % 16) % 8) * x::double uv
  from (select vec_id, unnest(range(64)) pos, unnest(embedding) x from embeddings))"""


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state marker per block, labelled by the block's first vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    blocks = vectors.groupBy(F.expr("vec_id div 16").alias("blk")).agg(
        F.min_by("label", "vec_id").alias("label")
    )
    return blocks.select(
        F.concat(F.lit("S"), F.col("blk") % 2).alias("session_id"),
        F.expr("(blk div 2) * 64").alias("sample_index"),
        (F.lit(150) + F.col("label")).alias("marker_id"),
        F.concat(F.lit("state_"), F.col("label")).alias("label"),
    )


M_SQL = """m as (
  select 'S' || (blk % 2) session_id, (blk // 2) * 64 sample_index,
         150 + label marker_id, 'state_' || label as label
  from (select vec_id // 16 blk, arg_min(label, vec_id) as label from embeddings group by 1))"""


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as one sample stream per (user parity, event type)."""
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), F.col("user_id") % 2).alias("session_id"),
        F.col("event_type").alias("channel"),
        "event_id",
        "ts",
        F.col("value").alias("uv"),
    )
    hour = F.floor(micros_of("ts") / 3600000000)
    out = numbered(ev, ["session_id", "channel"], hour, [F.col("ts"), F.col("event_id")])
    return out.select("session_id", "channel", F.col("rn").alias("sample_idx"), "uv", "ts")


E_SQL = """e as (
  select 'E' || (user_id % 2) session_id, event_type channel,
         row_number() over (partition by user_id % 2, event_type order by ts, event_id) - 1 sample_idx,
         value uv, ts from events)"""


def volume_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as many short recordings, for volume."""
    li = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("L"), F.col("l_suppkey")).alias("session_id"),
        F.col("l_linenumber").alias("channel_idx"),
        "l_shipdate",
        "l_orderkey",
        F.col("l_quantity").alias("uv"),
    )
    out = numbered(
        li,
        ["session_id", "channel_idx"],
        F.expr("year(l_shipdate) * 12 + month(l_shipdate)"),
        [F.col("l_shipdate"), F.col("l_orderkey"), F.col("uv")],
    )
    return out.select(
        "session_id",
        F.concat(F.lit("c"), F.col("channel_idx")).alias("channel"),
        "channel_idx",
        F.col("rn").alias("sample_idx"),
        "uv",
    )


L_SQL = """l as (
  select 'L' || l_suppkey session_id, 'c' || l_linenumber channel, l_linenumber channel_idx,
         row_number() over (partition by l_suppkey, l_linenumber
                            order by l_shipdate, l_orderkey, l_quantity) - 1 sample_idx,
         l_quantity uv from lineitem)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier output per document: truth, score and the toxic flag."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").alias("truth"),
        "toxic",
        F.col("n_chars").cast("double").alias("score"),
        "lang",
        "source",
    )


K_SQL = """k as (
  select l.doc_id, l.quality truth, l.toxic, d.n_chars::double score, d.lang, d.source
  from labels l join documents d using (doc_id))"""
