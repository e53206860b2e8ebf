"""Text and JSON logs: signal-quality lines and paradigm event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layout import numbered
from ..operators.quality import grade
from ..schema import EVENT_LOG

def quality_lines(quality: DataFrame, step_sec: float = 1.0) -> DataFrame:
    """(session_id, win, value): the text line of each time point, channels in order."""
    pct = F.format_string(
        "  %-4s r=%4.0f s=%6.1f l=%3.0f%%", "channel", "rail_pct", "std_uv", F.col("line_ratio") * 100
    )
    parts = F.array_sort(F.collect_list(F.struct("channel_idx", pct.alias("txt"))))
    head = F.format_string("[sq] t=%6.1f", (F.col("win") + 1) * F.lit(float(step_sec)))
    return (
        quality.groupBy("session_id", "win")
        .agg(parts.alias("p"))
        .select("session_id", "win", F.concat(head, F.array_join(F.col("p.txt"), "")).alias("value"))
    )


def parse_quality_lines(lines: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """(session_id, t, channel, channel_idx, rail_pct, std_uv, line_ratio, status) from text lines.

    A line is read word by word: ``r``, ``s`` and ``l`` belong to the name before them. A line lacking
    one of the expected channels is dropped whole; the index is the channel's place in ``channels``,
    other channels of the line are left out. Without ``channels`` it is the place within the line.
    Grading uses the bench limits without the suspicious-signal rule.
    """
    # "r= 12" and "r=12" are both one word after this
    words = F.split(F.trim(F.regexp_replace("value", "= +", "=")), " +")
    timed = lines.select("session_id", "value", words.alias("w"))
    timed = timed.withColumn("t", F.element_at(F.filter("w", lambda x: x.startswith("t=")), 1)).where("size(filter(w, x -> x like 't=%')) > 0")
    named = F.filter(F.sequence(F.lit(1), F.size("w") - 3), lambda i: _key(i + 1, "r") & _key(i + 2, "s") & _key(i + 3, "l"))
    entries = F.transform(
        named, lambda i: F.struct(_word(i).alias("c"), _number(i + 1).alias("r"), _number(i + 2).alias("s"), _number(i + 3).alias("l"))
    )
    rows = timed.withColumn("e", F.when(F.size("w") > 3, entries).otherwise(F.array().cast("array<struct<c:string,r:double,s:double,l:double>>")))
    if channels is not None:
        wanted = F.array(*[F.lit(c) for c in channels])
        rows = rows.where(F.size(F.array_except(wanted, F.col("e.c"))) == 0)
    time = F.substring("t", 3, 40).cast("double").alias("t")
    flat = rows.select("session_id", time, F.posexplode("e").alias("at", "x"))
    if channels is not None:
        flat = flat.withColumn("at", F.array_position(wanted, F.col("x.c")).cast("int") - 1).where("at >= 0")
    parsed = flat.select(
        "session_id", "t", F.col("x.c").alias("channel"), F.col("at").alias("channel_idx"),
        F.col("x.r").alias("rail_pct"), F.col("x.s").alias("std_uv"), (F.col("x.l") / 100).alias("line_ratio"),
    )
    return grade(parsed, quiet=False)


def _word(i: Column) -> Column:
    return F.element_at(F.col("w"), i)


def _key(i: Column, name: str) -> Column:
    return _word(i).startswith(name + "=")


def _number(i: Column) -> Column:
    """The value behind ``x=``, without a percent sign; null if it is no number."""
    return F.rtrim(F.substring(_word(i), 3, 40), F.lit("%")).try_cast("double")


def read_quality_log(spark: SparkSession, path: str, channels: Sequence[str] | None = None) -> DataFrame:
    """Parsed lines of log files; a session is a file by its whole path, as two folders may use a name."""
    return parse_quality_lines(spark.read.text(path).withColumn("session_id", F.input_file_name()), channels)


def event_documents(events: DataFrame, config: dict[str, float], bucket, per_document: int = 1000) -> DataFrame:
    """(session_id, part, config, events): a session's events in time order, as documents.

    A document holds at most ``per_document`` events; a usual session is one
    document, a huge one is a numbered sequence.  ``bucket`` is monotone in t_sec.
    """
    ranked = numbered(events, ["session_id"], bucket, [F.col("t_sec"), F.col("event"), F.col("label")])
    entry = F.struct(F.col("t_sec").alias("timestamp"), "event", "condition", "label")
    cfg = F.create_map(*[F.lit(v) for kv in config.items() for v in kv])
    return (
        ranked.groupBy("session_id", F.expr(f"rn div {per_document}").alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("events"))
        .select("session_id", "part", cfg.alias("config"), "events")
    )


def write_event_logs(documents: DataFrame, path: str) -> None:
    documents.write.mode("append").json(path)


def read_event_logs(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, timestamp, event, condition, label), one row per logged event."""
    schema = T.StructType([T.StructField("session_id", T.StringType()), *EVENT_LOG.fields])
    docs = spark.read.schema(schema).json(path)
    return docs.select("session_id", F.explode("events").alias("e")).select("session_id", "e.*")
