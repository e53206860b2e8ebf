"""Streaming forms over the same tables, drained and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...dims import BANDS, BENCH
from ...functions.expr import micros_of
from ...session import scratch_path
from ...streaming import operators as S
from ...streaming import run, state
from .. import views
from .base import S_SQL, bands_sql, pick, query, sel, spectrum_sql, windows_sql, with_
from .quality import _QUALITY_CTE, notch_sql, status_sql


def source(spark, sf, name):
    """A table of the folder as a file stream, be it one file or a folder of parts.

    A folder is streamed as itself, with its partition columns if it has any; a single file only
    through a pattern, here one that matches just its name.
    """
    rows = views.table(spark, sf, name)
    single = all(path.endswith(f"/{name}.parquet") for path in rows.inputFiles())
    return spark.readStream.schema(rows.schema).parquet(f"{sf}/{name}[.]parquet" if single else f"{sf}/{name}.parquet")


def sample_stream(spark, sf):
    return S.with_event_time(views.from_embeddings(source(spark, sf, "embeddings").select("vec_id", "embedding")))


KEYS = ["session_id", "channel_idx"]


@query(
    "m1_ingest_fan_out",
    with_(S_SQL) + "select consumer, session_id, channel, count(*) n, round(avg(uv), 6) + 0.0 mean_uv from s, (values ('sure'), ('unsure')) c(consumer) group by all",
)
def m1(spark, sf):
    """One stream, two consumers; one fails twice and has every row once all the same."""
    out = scratch_path(spark, "fan-out")
    calls = []

    def to(name, failures):
        def store(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
            if len(calls) < failures:  # after the write: the rows are there once already
                calls.append(batch_id)
                raise RuntimeError("consumer down")

        return store

    stream = sample_stream(spark, sf).drop("ts")
    run.fan_out(stream, {"sure": to("sure", 0), "unsure": to("unsure", 2)}, scratch_path(spark, "fan-out-state"))
    back = spark.read.schema(stream.schema).parquet(*[f"{out}/{name}/batch=*" for name in ("sure", "unsure")])
    both = back.withColumn("consumer", F.element_at(F.split(F.input_file_name(), "/"), -3))
    agg = both.groupBy("consumer", "session_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.avg("uv").alias("mean_uv"))
    return pick(agg, "consumer session_id channel n mean_uv:6")


@query(
    "m2_sliding_quality",
    with_(S_SQL, windows_sql("wn", hop=125), notch_sql(250), _QUALITY_CTE)
    + f"select session_id, channel_idx, win, round(rail_pct, 6) rail_pct, round(std_uv, 6) std_uv, round(line_ratio, 6) line_ratio, ({status_sql(BENCH)})::int status from ql",
)
def m2(spark, sf):
    """Every full window, numbered by its start second."""
    done = run.drain_latest(S.sliding_quality(sample_stream(spark, sf), KEYS, n_full=250), [*KEYS, "start_ts"], "quality")
    rows = done.withColumn("win", F.expr("unix_seconds(start_ts)") - F.expr("unix_seconds(timestamp'2024-01-01 00:00:00')"))
    return pick(rows, "session_id channel_idx win rail_pct:6 std_uv:6 line_ratio:6 status")


@query("m3_latest_seconds", with_(S_SQL) + "select session_id, channel_idx, last_idx, count(*) n, round(avg(uv), 6) + 0.0 mean_uv from (select *, max(sample_idx) over (partition by session_id, channel_idx) last_idx from s) where sample_idx > last_idx - 500 group by all")
def m3(spark, sf):
    done = run.drain(state.latest_seconds(sample_stream(spark, sf), KEYS, 4.0), "latest")
    newest = done.groupBy(*KEYS).agg(F.max_by(F.struct("last_idx", "x"), "last_idx").alias("s")).select(*KEYS, "s.*")
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return pick(newest.select(*KEYS, "last_idx", F.size("x").cast("bigint").alias("n"), mean.alias("mean_uv")), "session_id channel_idx last_idx n mean_uv:6")


@query(
    "m4_insert_markers",
    "select 'S' || ((vec_id // 16) % 2) session_id, (vec_id // 32) * 64 sample_index, 150 + label marker_id, 'state_' || label as label from embeddings",
)
def m4(spark, sf):
    """Every vector's label arrives as a mark 3 ms after its first sample, between two samples."""
    marks = source(spark, sf, "embeddings").select(
        F.concat(F.lit("S"), F.expr("(vec_id div 16) % 2")).alias("session_id"),
        F.expr("(vec_id div 32) * 64").alias("sample_idx"),
        (F.lit(150) + F.col("label")).alias("marker_id"),
        F.concat(F.lit("state_"), F.col("label")).alias("label"),
    )
    timed = S.with_event_time(marks).drop("sample_idx").withColumn("ts", F.col("ts") + F.expr("interval 3 milliseconds"))
    # the montage lacks its first channel
    return run.drain(S.insert_markers(sample_stream(spark, sf).where("channel_idx > 0"), timed), "marks")


@query("m5_durable_sink", with_(S_SQL) + "select session_id, channel_idx, sample_idx, round(uv, 6) + 0.0 uv from s")
def m5(spark, sf):
    done = run.drain(sample_stream(spark, sf).drop("ts"), "sink", partition_by=["session_id"])
    return pick(done, "session_id channel_idx sample_idx uv:6")


@query("m6_running_totals", with_(S_SQL) + "select session_id, count(*) total, max(sample_idx) + 1 n_samples, (max(sample_idx) + 1) / 125.0::double elapsed_sec from s group by 1")
def m6(spark, sf):
    return run.drain_latest(S.running_totals(sample_stream(spark, sf)), ["session_id"], "totals")


@query(
    "m7_fixed_chunks",
    with_(S_SQL)
    + "select session_id, channel_idx, chunk_no, n, round(m, 6) + 0.0 mean_uv from (select session_id, channel_idx, sample_idx // 256 chunk_no, count(*) n, avg(uv) m from s group by all) where n = 256",
)
def m7(spark, sf):
    done = run.drain_latest(S.fixed_chunks(sample_stream(spark, sf), KEYS, delay="1 second"), [*KEYS, "chunk_no"], "chunks")
    return pick(done, "session_id channel_idx chunk_no n mean_uv:6")


@query(
    "m2_event_windows",
    """with w as (select 'E' || (user_id % 2) session_id, event_type channel, unnest([0, 1]) o, ts, value from events),
  x as (select session_id, channel, (epoch_us(ts) // 1800000000 - o) * 1800 start_sec, value from w)
  select session_id, channel, start_sec, count(*) n, round(avg(value), 6) + 0.0 mean_uv, round(stddev_pop(value), 6) + 0.0 std_uv from x group by all""",
)
def m2_events(spark, sf):
    """Event values over sliding hours: late rows, sparse windows, real event times."""
    ev = source(spark, sf, "events").select(
        F.concat(F.lit("E"), F.col("user_id") % 2).alias("session_id"),
        F.col("event_type").alias("channel"),
        F.timestamp_micros(micros_of("ts")).alias("ts"),
        F.col("value").alias("uv"),
    )
    hours = S.sliding_std(ev, ["session_id", "channel"], "1 hour", "30 minutes", "60 seconds")
    done = run.drain_latest(hours, ["session_id", "channel", "start_ts"], "hours")
    rows = done.withColumn("start_sec", F.expr("unix_seconds(start_ts)"))
    return pick(rows, "session_id channel start_sec n mean_uv:6 std_uv:6")


@query(
    "p3_stateful_notch",
    with_(S_SQL, notch_sql(900))
    + "select s.session_id, s.channel_idx, s.sample_idx + k sample_idx, round(sum(s.uv * h.v), 5) + 0.0 uv from s join (select session_id, channel_idx, max(sample_idx) n1 from s group by all) e using (session_id, channel_idx), h where s.sample_idx + k <= n1 group by all",
)
def p3(spark, sf):
    return pick(run.drain(state.stateful_notch(sample_stream(spark, sf), KEYS), "notch"), "session_id channel_idx sample_idx uv:5")


_BANDS = " ".join(f"{b}:6" for b in BANDS)


# one-second windows every 250 ms: window k holds the 125 samples from index ceil(31.25 k) on
_QUARTERS = """wn as (select * from (
    select t.*, q.win, t.sample_idx - (q.win * 125 + 3) // 4 j, 125 n, count(*) over (partition by t.session_id, t.channel_idx, q.win) c
    from s t join (select unnest(range((select max(sample_idx) * 4 // 125 + 1 from s))) win) q
      on t.sample_idx >= (q.win * 125 + 3) // 4 and t.sample_idx < (q.win * 125 + 3) // 4 + 125)
  where c = 125)"""


@query(
    "p4_streaming_band_power",
    with_(S_SQL, _QUARTERS, spectrum_sql("sp", "wn", "session_id, channel_idx, win"), bands_sql("bp", "sp", "session_id, channel_idx, win"))
    + f"select session_id, channel_idx, win, {sel(_BANDS)} from bp",
)
def p4(spark, sf):
    """Every full window of a second, a quarter of a second apart."""
    done = run.drain_latest(S.sliding_band_power(sample_stream(spark, sf), KEYS), [*KEYS, "start_ts"], "bands")
    start = F.expr("unix_millis(start_ts) - unix_millis(timestamp'2024-01-01 00:00:00')")
    rows = done.where("n = 125").withColumn("win", (start / 250).cast("bigint"))
    return pick(rows, "session_id channel_idx win " + _BANDS)
