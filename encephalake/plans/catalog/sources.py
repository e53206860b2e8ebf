"""Reading, writing and registering recordings, sessions, encodings, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...dims import values_table
from ...operators.project import artifact_components
from ...session import scratch_path
from ...sources import encodings as X
from ...sources import array_folders, logs, recordings, sessions
from .. import views
from .base import L_SQL, M_SQL, S_SQL, encoded_sql, pick, query, sel, with_
from .evaluation import _ALL, _FOUR, _TEMPLATES, templates, templates_sql
from .evaluation import encodings as encoded_windows
from .projections import COMPONENTS_SQL, _REJECTED, components

_UV = "session_id channel sample_idx uv:6"


@query("a1_read_recordings", with_(S_SQL) + "select session_id, channel, sample_idx, sample_idx / 125.0::double t_sec, round(uv * 1e-6, 12) + 0.0 volts from s")
def a1(spark, sf):
    """The view written as array folders, 500 samples each, and read back through the data source."""
    root = scratch_path(spark, "folders")
    array_folders.write(views.samples(spark, sf), root, part=500).write.format("noop").mode("overwrite").save()
    back = array_folders.read(spark, root)
    df = back.withColumn("t_sec", F.col("sample_idx") / 125.0).withColumn("volts", F.col("uv") * 1e-6)
    return pick(df, "session_id channel sample_idx t_sec volts:12")


@query(
    "a2_rows_of_kind",
    with_(L_SQL)
    + """select e.session_id, e.channel_idx row_idx, e.sample_idx, e.uv, round(coalesce(b.uv + (e.sample_idx - b.sample_idx) / 125.0::double, e.sample_idx / 125.0::double), 6) t_sec
  from (select * from l where channel_idx <= 5) e asof left join (select * from l where channel_idx = 6) b on e.session_id = b.session_id and e.sample_idx >= b.sample_idx""",
)
def a2(spark, sf):
    """Channel rows with the board's time, which is row 6 and ends earlier than some channels."""
    kinds = [(i, "eeg" if i <= 5 else "timestamp" if i == 6 else "marker") for i in range(1, 8)]
    table = values_table(spark, ["row_idx", "kind"], kinds)
    rows = views.volume_samples(spark, sf).withColumnRenamed("channel_idx", "row_idx")
    times = recordings.by_kind(rows, table, "timestamp").select("session_id", "sample_idx", F.col("uv").alias("board_sec"))
    out = recordings.board_time(recordings.by_kind(rows, table).select("session_id", "row_idx", "sample_idx", "uv"), times)
    return pick(out, "session_id row_idx sample_idx uv t_sec:6")


@query(
    "a3_session_markers",
    with_(S_SQL, M_SQL)
    + """, e as (select session_id, count(*) n_samples, max(sample_idx) / 125.0::double last_sec from s group by 1)
  select session_id, sample_index, marker_id, label, sample_index / 125.0::double onset_sec, 0.0::double duration_sec, n_samples, last_sec from m join e using (session_id)""",
)
def a3(spark, sf):
    """A stored session as ``read_session`` gives it: markers with onsets, and the extent of its samples."""
    root = scratch_path(spark, "session")
    recordings.append(views.samples(spark, sf), root, "samples")
    recordings.append(views.markers(spark, sf), root, "markers")
    samples, markers = recordings.read_session(spark, root)
    extent = samples.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_samples"), F.max("t_sec").alias("last_sec"))
    return markers.join(extent, "session_id")


@query("a4_append_samples", with_(S_SQL) + "select session_id, channel, count(*) n, max(sample_idx) last_idx, round(avg(uv), 6) + 0.0 mean_uv from s group by all")
def a4(spark, sf):
    """Two appends (by half of the blocks) into one table, read back."""
    root = scratch_path(spark, "recordings")
    data = views.samples(spark, sf)
    early = F.col("sample_idx") < 512
    recordings.append(data.where(early), root, "samples")
    recordings.append(data.where(~early), root, "samples")
    back = recordings.read_table(spark, root, "samples")
    out = back.groupBy("session_id", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.max("sample_idx").alias("last_idx"), F.avg("uv").alias("mean_uv")
    )
    return pick(out, "session_id channel n last_idx mean_uv:6")


@query(
    "a5_cleaned_provenance",
    with_(S_SQL, M_SQL, COMPONENTS_SQL)
    + f""", ex as (select 'S' || (substr(session_id, 2)::bigint % 2) session_id, component, label from {_REJECTED} group by all),
  rm as (select count(*) n_removed, coalesce(string_agg(label, ',' order by component), '') l from ex where session_id = 'S1'),
  mk as (select session_id, count(*) n_markers from m group by 1),
  fb as (select 'S' || (user_id % 2) session_id, count(*) n_feedback, round(sum(value::float::double), 3) sum_state from events group by 1),
  ch as (select session_id, channel, session_id = 'S1' cleaned, count(*) n, avg(uv) mean, max(sample_idx) * 0.01::double last from s group by all)
  select session_id, channel, n, round(case when cleaned then mean * 0.5 else mean end, 6) + 0.0 mean_uv, round(last, 6) last_sec, n_markers, n_feedback, sum_state, 'rest' as task,
    case when cleaned then 'true' end ica_applied, case when cleaned then 'events' end ica_source, case when cleaned then n_removed::varchar end ica_n_excluded, case when cleaned then l end ica_excluded_labels
  from ch join mk using (session_id) join fb using (session_id), rm""",
)
def a5(spark, sf):
    """Two sessions are stored, one is cleaned as a version of its own, and all tables are read again."""
    root = scratch_path(spark, "versions")
    samples = views.samples(spark, sf).withColumn("t_sec", F.col("sample_idx") * 0.01)
    feedback = views.table(spark, sf, "events").select(
        F.concat(F.lit("S"), F.col("user_id") % 2).alias("session_id"), (F.col("event_id") * 0.5).alias("t_sec"), F.col("value").alias("state")
    )
    registered = sessions.register(samples, attrs={"task": "rest"})
    recordings.write_version(spark, root, {"samples": samples, "markers": views.markers(spark, sf), "feedback": feedback, "sessions": registered})
    found = artifact_components(components(spark, sf), 0.5)
    user = F.expr("concat('S', cast(substr(session_id, 2) as bigint) % 2)")
    removed = found.select(user.alias("session_id"), "component", "label").distinct()
    stored = recordings.read_version(spark, root, "samples").where("session_id = 'S1'")
    recordings.save_cleaned(spark, root, stored.withColumn("uv", F.col("uv") * 0.5), removed, "events")
    back, markers = recordings.read_session(spark, root)
    out = back.groupBy("session_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.avg("uv").alias("mean_uv"), F.max("t_sec").alias("last_sec"))
    marked = markers.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_markers"))
    state = F.sum(F.col("state").cast("double")).alias("sum_state")
    fed = recordings.read_version(spark, root, "feedback").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_feedback"), state)
    names = ["task", "ica_applied", "ica_source", "ica_n_excluded", "ica_excluded_labels"]
    facts = recordings.read_version(spark, root, "sessions").select("session_id", *[F.col("attrs")[n].alias(n) for n in names])
    joined = out.join(marked, "session_id").join(fed, "session_id").join(facts, "session_id")
    return pick(joined, "session_id channel n mean_uv:6 last_sec:6 n_markers n_feedback sum_state:3 " + " ".join(names))


@query(
    "p7_percent_csv",
    with_(S_SQL)
    + """select session_id, channel_idx, sample_idx, case when channel_idx = 1 and sample_idx % 50 = 7 then null else round(uv, 6) + 0.0 end uv
  from (select distinct session_id, sample_idx, unnest(range(16))::int channel_idx from s) left join s using (session_id, sample_idx, channel_idx)""",
)
def p7(spark, sf):
    """An export per session, each in a folder of its own, with header lines, cells that are no numbers and missing ones."""
    root = scratch_path(spark, "exports")
    cell = F.when((F.col("channel_idx") == 1) & (F.col("sample_idx") % 50 == 7), F.lit("railed")).otherwise(F.col("uv").cast("string"))
    held = F.map_from_entries(F.collect_list(F.struct("channel_idx", cell.alias("v"))))
    cells = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.col("held")[i], F.lit(""))), ", ")
    data = views.samples(spark, sf)
    points = data.groupBy("session_id", "sample_idx").agg(held.alias("held"))
    lines = points.select("session_id", "sample_idx", F.concat_ws(", ", (F.col("sample_idx") % 256).cast("string"), cells).alias("value"))
    head = data.select("session_id").distinct().select("session_id", F.explode(F.array(F.struct(F.lit(-2).alias("sample_idx"), F.lit("%OpenExport").alias("value")), F.struct(F.lit(-1).alias("sample_idx"), F.lit("%Sample Rate = 125 Hz").alias("value")))).alias("h"))
    whole = lines.unionByName(head.select("session_id", "h.*"))
    # an export is one file, so a session is one task here
    whole.repartition("session_id").sortWithinPartitions("session_id", "sample_idx").select("value", F.col("session_id").alias("recording")).write.partitionBy("recording").text(root)
    back = recordings.read_percent_csv(spark, f"{root}/*/*.txt")
    return pick(back.withColumn("session_id", F.regexp_extract("file", "recording=([^/]+)", 1)), "session_id channel_idx sample_idx uv:6")


def stored_encoding(spark, sf):
    pn = encoded_windows(spark, sf).withColumnRenamed("win", "sample_idx")
    return pn.select("session_id", "channel", "channel_idx", "sample_idx", "a", "b", "c")


_PN = "session_id channel sample_idx a:6 b:6 c:6"
_NAMES = "['Fp1','Fp2','F3','F4','F7','F8','Fz','Oz','C3','C4','Pz','Cz','P3','O2','O1','P4'][channel_idx + 1]"


@query(
    "a6_encoding_round_trip",
    with_(S_SQL, encoded_sql(62)) + f"select session_id, {_NAMES} channel, win sample_idx, round(a, 6) a, round(b, 6) b, round(c, 6) c from pns",
)
def a6(spark, sf):
    path = scratch_path(spark, "encoding")
    X.save_encoding(stored_encoding(spark, sf), path)
    return pick(X.load_encoding(spark, path), _PN)


@query(
    "a7_interchange_document",
    with_(S_SQL, encoded_sql(62))
    + f"""select session_id, 'S000' subject_id, 125.0::double sample_rate, (max(n) over (partition by session_id))::bigint n_samples, ch channel, n::bigint n_values, round(sa, 4) sum_a, round(fb, 6) first_b from (
    select session_id, {_NAMES} ch, count(*) n, sum(a) sa, arg_min(b, win) fb from pns group by all)""",
)
def a7(spark, sf):
    """Written documents, parsed back to one row per channel."""
    docs = X.interchange_documents(stored_encoding(spark, sf))
    schema = (
        "metadata struct<subject_id:string,session_id:string,sample_rate:double,channels:array<string>,n_samples:bigint>, "
        "pn_parameters map<string,struct<a:array<double>,b:array<double>,c:array<double>>>"
    )
    d = docs.select(F.from_json("document", schema).alias("d")).select("d.metadata.*", F.explode("d.pn_parameters").alias("channel", "v"))
    total = F.aggregate("v.a", F.lit(0.0), lambda s, x: s + x)
    return pick(
        d.select("session_id", "subject_id", "sample_rate", "n_samples", "channel", F.size("v.a").cast("bigint").alias("n_values"),
                 total.alias("sum_a"), F.col("v.b")[0].alias("first_b")),
        "session_id subject_id sample_rate n_samples channel n_values sum_a:4 first_b:6",
    )


@query(
    "a9_event_log_round_trip",
    "select 'U' || user_id session_id, event_id::double \"timestamp\", event_type as event, json_extract(props, '$.k')::int as condition, event_type || '_' || json_extract(props, '$.k') as label from events",
)
def a9(spark, sf):
    k = F.get_json_object("props", "$.k")
    events = views.table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("session_id"),
        F.col("event_id").cast("double").alias("t_sec"),
        F.col("event_type").alias("event"),
        k.cast("int").alias("condition"),
        F.concat_ws("_", "event_type", k).alias("label"),
    )
    path = scratch_path(spark, "event-log")
    docs = logs.event_documents(events, {"n_cycles": 3.0}, F.floor(F.col("t_sec") / 1000))
    logs.write_event_logs(docs, path)
    return logs.read_event_logs(spark, path)


_REG = "session_id subject_id session_type duration_sec n_channels status montage_version"


@query(
    "a10_register_sessions",
    with_(S_SQL) + "select session_id, 'S001' subject_id, 'resting' session_type, (max(sample_idx) + 1) / 125.0::double duration_sec, count(distinct channel_idx)::int n_channels, 'recorded' status, '2026-04-26-o2-on-fast-channel' montage_version from s group by 1",
)
def a10(spark, sf):
    root = scratch_path(spark, "registry")
    recordings.append(sessions.register(views.samples(spark, sf), "S001"), root, "sessions")
    return recordings.read_table(spark, root, "sessions").select(*_REG.split())


def registry(spark, sf):
    """Orders as registered sessions: the status letter is the subject."""
    return views.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("subject_id"),
        F.concat(F.lit("O"), F.col("o_orderkey")).alias("session_id"),
        F.col("o_orderpriority").alias("session_type"),
        F.col("o_totalprice").alias("duration_sec"),
    )


@query(
    "a11_query_sessions",
    "select o_orderstatus subject_id, 'O' || o_orderkey session_id, o_orderpriority session_type, o_totalprice duration_sec from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'",
)
def a11(spark, sf):
    return sessions.query_sessions(registry(spark, sf), "F", "1-URGENT")


@query("a12_list_sessions", "select distinct 'P' || l_suppkey subject_id, 'O' || l_orderkey session_id from lineitem")
def a12(spark, sf):
    objects = views.table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_suppkey")).alias("subject_id"), F.concat(F.lit("O"), F.col("l_orderkey")).alias("session_id")
    )
    return sessions.list_sessions(objects)


def template_round_trip(spark, sf, subset):
    path = scratch_path(spark, "templates")
    rows = templates(spark, sf, subset).select(
        F.concat(F.lit("class_"), F.col("label")).alias("name"), "label", F.lit(int(subset)).alias("n_channels"), "n_segments",
        "members", "norm", F.create_map(F.lit("encoding"), F.lit("bands")).alias("metadata"),
    )
    X.save_templates(rows, path)
    return pick(X.load_templates(spark, path), "label n_segments norm:6")


@query("a13_template_round_trip", templates_sql(_FOUR) + _TEMPLATES)
def a13(spark, sf):
    return template_round_trip(spark, sf, "4")


@query("a13_template_round_trip_16", templates_sql(_ALL) + _TEMPLATES)
def a13_all(spark, sf):
    return template_round_trip(spark, sf, "16")
