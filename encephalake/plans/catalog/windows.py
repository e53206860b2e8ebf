"""Windows, segments, schedules and state joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ...functions.expr import micros_of
from ...operators import windows as W
from ...operators.spectral import encode_sliding
from .. import views
from .base import M_SQL, S_SQL, STATES_SQL, encoded_sql, pick, query, windows_sql, with_

_F1 = "session_id channel_idx win center_sec n mean_uv:6"
_SLIDE_AGG = "select session_id, channel_idx, win, (win * {hop} + 125.0::double) / 125 center_sec, count(*) n, round(avg(uv), 6) + 0.0 mean_uv from wn group by all"


@query("f1_sliding_windows", with_(S_SQL, windows_sql("wn", hop=125)) + _SLIDE_AGG.format(hop=125))
def f1(spark, sf):
    w, hop = W.window_shape(2.0, 0.5)
    return pick(W.sliding(views.samples(spark, sf), w, hop, [F.avg("uv").alias("mean_uv")]), _F1)


def parity_labels(spark, sf):
    """Marker order as segment number; odd states are class 1, even ones class 0."""
    return views.markers(spark, sf).select(
        "session_id", F.expr("sample_index div 64").alias("seg"), ((F.col("marker_id") - 150) % 2).alias("label")
    )


PARITY_SQL = "lab as (select session_id, sample_index // 64 seg, (marker_id - 150) % 2 as label from m)"
SEGMENTS_SQL = """seg as (
  select s.session_id, channel, channel_idx, sample_idx, uv, sample_idx // len seg, sample_idx % len j, len n, label
  from s join (select session_id, channel_idx, count(*) // any_value(k) len, any_value(k) k from s join
               (select session_id, count(*) k from lab group by 1) using (session_id) group by 1, 2) z using (session_id, channel_idx)
  join lab on lab.session_id = s.session_id and lab.seg = sample_idx // len where sample_idx // len < k)"""
_F2 = "session_id channel_idx seg label seg_len n mean_uv:6"


@query(
    "f2_equal_segments",
    with_(S_SQL, M_SQL, PARITY_SQL, SEGMENTS_SQL)
    + "select session_id, channel_idx, seg, label, n seg_len, count(*) n, round(avg(uv), 6) + 0.0 mean_uv from seg group by session_id, channel_idx, seg, label, seg.n",
)
def f2(spark, sf):
    cut = W.equal_segments(views.samples(spark, sf), parity_labels(spark, sf))
    out = cut.groupBy("session_id", "channel_idx", "seg", "label", "seg_len").agg(
        F.count(F.lit(1)).alias("n"), F.avg("uv").alias("mean_uv")
    )
    return pick(out, _F2)


def windowed_means(spark, sf, w: int = 250, hop: int = 62):
    return W.sliding(views.samples(spark, sf), w, hop, [F.avg("uv").alias("mean_uv")])


def intervals(spark, sf, **kw):
    return W.state_intervals(views.markers(spark, sf), W.recording_ends(views.samples(spark, sf)), **kw)


_WIN62 = "agg as (select session_id, channel_idx, win, (win * 62 + 125.0::double) / 125 center_sec, avg(uv) mean_uv from wn group by all)"


@query(
    "f3_assign_states",
    with_(S_SQL, M_SQL, STATES_SQL, windows_sql("wn", hop=62), _WIN62)
    + "select agg.session_id, channel_idx, win, label, round(mean_uv, 6) + 0.0 mean_uv from agg join iv on agg.session_id = iv.session_id and center_sec >= onset_sec and center_sec < end_sec",
)
def f3(spark, sf):
    out = W.assign_states(windowed_means(spark, sf), intervals(spark, sf))
    return pick(out, "session_id channel_idx win label mean_uv:6")


OPEN_CLOSED = {
    "open": [f"state_{i}" for i in range(0, 10, 2)],
    "closed": [f"state_{i}" for i in range(1, 10, 2)],
}


@query(
    "f4_merge_states",
    with_(S_SQL, M_SQL, STATES_SQL, windows_sql("wn", hop=62), _WIN62)
    + """select agg.session_id, case when right(label, 1)::int % 2 = 0 then 'open' else 'closed' end state_group, count(*) n, round(avg(mean_uv), 6) + 0.0 mean_uv
     from agg join iv on agg.session_id = iv.session_id and center_sec >= onset_sec and center_sec < end_sec group by all""",
)
def f4(spark, sf):
    merged = W.merge_states(W.assign_states(windowed_means(spark, sf), intervals(spark, sf)), OPEN_CLOSED)
    out = merged.groupBy("session_id", "state_group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mean_uv").alias("mean_uv")
    )
    return pick(out, "session_id state_group n mean_uv:6")


def open_closed_markers(spark, sf):
    """State markers as eyes-open (numbered by state) and eyes-closed ones."""
    n = F.col("marker_id") - 150
    return views.markers(spark, sf).select(
        "session_id",
        "sample_index",
        F.when(n % 2 == 0, 151).otherwise(152).alias("marker_id"),
        F.when(n % 2 == 0, F.concat(F.lit("eyes_open_"), n)).otherwise("eyes_closed").alias("label"),
    )


MARKED_SQL = """oc as (select session_id, sample_index, case when marker_id % 2 = 0 then 151 else 152 end marker_id,
    case when marker_id % 2 = 0 then 'eyes_open_' || (marker_id - 150) else 'eyes_closed' end as segment from m),
ms as (select session_id, segment, arg_max(sample_index, sample_index) start_idx, arg_max(end_idx, sample_index) end_idx from (
    select oc.*, coalesce(lead(sample_index) over (partition by oc.session_id order by sample_index), n) end_idx
    from oc join (select session_id, max(sample_idx) + 1 n from s group by 1) using (session_id)) group by all)"""


def phase_segments(spark, sf):
    return W.marker_segments(open_closed_markers(spark, sf), W.recording_ends(views.samples(spark, sf)))


@query("f5_marker_segments", with_(S_SQL, M_SQL, MARKED_SQL) + "select session_id, segment, start_idx, end_idx from ms")
def f5(spark, sf):
    return phase_segments(spark, sf)


SHORT_BLOCKS = [("eyes_open", 0, 1.0), ("eyes_closed", 1, 1.5)]
_SCHED_SQL = """ends as (select session_id, max(sample_idx) + 1 n from s group by 1),
sched as (select session_id, (cycle - 1) * 2.5 + off start_sec, dur duration_sec, cond as condition, lab as label, cycle::int as cycle
  from (select session_id, unnest(range(1, ceil(n / 312.5)::int + 1)) as cycle from ends),
       (values (0.0::double, 1.0::double, 0, 'eyes_open'), (1.0, 1.5, 1, 'eyes_closed')) b(off, dur, cond, lab))"""
_SEG_STEP = 0.25


def schedule(spark, sf):
    return W.block_schedule(W.cycles_for(views.samples(spark, sf), SHORT_BLOCKS), SHORT_BLOCKS)


@query(
    "f6_label_by_schedule",
    with_(S_SQL, _SCHED_SQL)
    + """select distinct g.session_id, g.seg, g.start_sec, coalesce(first_value(condition) over (partition by g.session_id, g.seg order by sched.start_sec), -1) as condition
   from (select distinct session_id, sample_idx // 31 seg, (sample_idx // 31) * 0.25::double start_sec, (sample_idx // 31) * 0.25::double + 0.5 end_sec from s) g
   left join sched on sched.session_id = g.session_id and g.start_sec >= sched.start_sec and g.end_sec <= sched.start_sec + duration_sec""",
)
def f6(spark, sf):
    seg = F.expr("sample_idx div 31")
    segments = (
        views.samples(spark, sf)
        .select("session_id", seg.alias("seg"))
        .distinct()
        .withColumn("start_sec", F.col("seg") * F.lit(_SEG_STEP))
        .withColumn("end_sec", F.col("start_sec") + 0.5)
    )
    return W.label_by_schedule(segments, schedule(spark, sf)).select("session_id", "seg", "start_sec", "condition")


@query("f7_block_schedule", with_(S_SQL, _SCHED_SQL) + "select session_id, start_sec, duration_sec, condition, label, cycle from sched")
def f7(spark, sf):
    return schedule(spark, sf)


@query(
    "f8_protocol_timeline",
    """with p as (select 'O' || l_orderkey session_id, l_linenumber, l_partkey, l_quantity dur, l_suppkey,
         sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate rows unbounded preceding) e from lineitem)
  select session_id, e - dur t_sec, 100 + l_linenumber code, 'start' as text from p
  union all select session_id, e, 200 + l_linenumber, 'end' from p where l_linenumber % 2 = 0""",
)
def f8(spark, sf):
    li = views.table(spark, sf, "lineitem")
    phases = li.select(
        F.concat(F.lit("O"), F.col("l_orderkey")).alias("session_id"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        F.col("l_quantity").alias("duration_sec"),
        (F.lit(100) + F.col("l_linenumber")).alias("start_code"),
        F.lit("start").alias("start_text"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit(200) + F.col("l_linenumber")).alias("end_code"),
        F.lit("end").alias("end_text"),
    )
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "duration_sec", "l_extendedprice", "l_shipdate")]
    return W.protocol_timeline(phases, ["session_id"], F.col("l_linenumber"), order)


def trials(spark, sf):
    return views.table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("session_id"), "event_id", "ts", "event_type",
        F.abs("value").alias("isi_sec"),
    )



@query(
    "f9_trial_onsets",
    """select 'U' || user_id session_id, event_id, event_type,
        floor(round(sum(abs(value)) over (partition by user_id order by ts, event_id rows unbounded preceding) * 125, 6))::bigint onset_sample from events""",
)
def f9(spark, sf):
    out = W.trial_onsets(
        trials(spark, sf), ["session_id"], F.floor(micros_of("ts") / 3600000000), [F.col("ts"), F.col("event_id")]
    )
    return out.select("session_id", "event_id", "event_type", "onset_sample")


@query(
    "f9_trial_totals",
    "select 'U' || user_id session_id, event_type, count(*) n_trials, round(sum(abs(value)), 4) duration_sec, round(avg(abs(value)), 6) mean_isi from events group by all",
)
def f9_totals(spark, sf):
    return pick(
        W.trial_totals(trials(spark, sf), ["session_id", "event_type"]),
        "session_id event_type n_trials duration_sec:4 mean_isi:6",
    )


@query(
    "f10_report_windows",
    """with k as (select 'U' || user_id session_id, epoch_us(ts) // 8000 sample_index, event_type as label from events where event_type not in ('click', 'view')),
  e as (select 'U' || user_id session_id, max(epoch_us(ts) // 8000) + 1 n from events group by 1),
  iv as (select k.session_id, sample_index / 125.0::double onset_sec, label, coalesce(lead(sample_index) over (partition by k.session_id order by sample_index) / 125.0::double, (n - 1) / 125.0::double) end_sec from k join e using (session_id))
  select session_id, round(onset_sec, 3) onset_sec, round(end_sec, 3) end_sec, label from iv where end_sec - onset_sec >= 4.0""",
)
def f10(spark, sf):
    marks = views.table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("session_id"),
        F.floor(micros_of("ts") / 8000).cast("bigint").alias("sample_index"),
        F.lit(0).alias("marker_id"),
        F.col("event_type").alias("label"),
    )
    ends = marks.groupBy("session_id").agg((F.max("sample_index") + 1).alias("n_samples"))
    out = W.report_windows(marks, ends, skip=["click", "view"])
    return pick(out, "session_id onset_sec:3 end_sec:3 label")


def power_by_window(m: np.ndarray, fs: float) -> np.ndarray:
    """A caller's model: total power and its largest channel share."""
    p = np.mean(m**2, axis=1)
    return np.array([p.sum(), p.max()])


@query(
    "f11_window_model_scores",
    with_(S_SQL, windows_sql("wn", hop=125))
    + """, p as (select session_id, win, channel_idx, avg(uv * uv) p from wn group by all),
  full_ as (select session_id, win from (select session_id, sample_idx // 125 b, sample_idx from s) t join (select distinct session_id s2, win from wn) q on s2 = session_id and sample_idx >= win * 125 and sample_idx < win * 125 + 250
            group by all having count(*) = 250 * (select count(distinct channel_idx) from s))
  select p.session_id, win, (win * 125 + 125.0::double) / 125 center_sec, round(sum(p), 4) total_power, round(max(p), 4) top_power from p join (select distinct session_id, win from full_) using (session_id, win) group by all""",
)
def f11(spark, sf):
    out = W.score_windows(views.samples(spark, sf), power_by_window, 2.0, 0.5)
    flat = out.select(
        "session_id", "win", "center_sec", F.col("embedding")[0].alias("total_power"), F.col("embedding")[1].alias("top_power")
    )
    return pick(flat, "session_id win center_sec total_power:4 top_power:4")


@query(
    "f12_midpoint_values",
    with_(S_SQL, encoded_sql(), M_SQL)
    + """, seg as (select session_id, sample_index // 64 seg, sample_index // 62 st from m),
  mid as (select seg.session_id, seg, least(st + 1, mx) win from seg join (select session_id, max(win) mx from pns group by 1) using (session_id))
  select session_id, seg, channel_idx, win as sample_idx, round(a, 6) a, round(b, 6) b, round(c, 6) c from mid join pns using (session_id, win)""",
)
def f12(spark, sf):
    pn = encode_sliding(views.samples(spark, sf), mode="per_channel").withColumnRenamed("win", "sample_idx")
    segments = views.markers(spark, sf).select(
        "session_id",
        F.expr("sample_index div 64").alias("seg"),
        F.expr("sample_index div 62").alias("start_idx"),
        F.lit(2).cast("bigint").alias("seg_len"),
    )
    return pick(W.midpoint_rows(pn, segments), "session_id seg channel_idx sample_idx a:6 b:6 c:6")
