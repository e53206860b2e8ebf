"""Units, lookups, subsets, crops and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...dims import CHANNEL_GROUPS, MONTAGES, SUBSETS, WIRE_COLORS
from ...operators import project as P
from ...operators.spectral import encode_sliding
from .. import views
from .base import L_SQL, M_SQL, S_SQL, encoded_sql, pick, query, sel, with_

_LIST = lambda xs: "[" + ",".join(f"'{x}'" for x in xs) + "]"
_IN = lambda xs: "(" + ",".join(f"'{x}'" for x in xs) + ")"

_UNITS = "session_id channel sample_idx volts:12 back_uv:6"


@query("b1_unit_conversion", with_(S_SQL) + "select session_id, channel, sample_idx, round(uv * 1e-6, 12) + 0.0 volts, round(uv * 1e-6 * 1e6, 6) + 0.0 back_uv from s")
def b1(spark, sf):
    df = P.to_microvolts(P.to_volts(views.samples(spark, sf)), out="back_uv")
    return pick(df, _UNITS)


@query(
    "b2_relabel_montage",
    with_(S_SQL)
    + f"select session_id, {_LIST(MONTAGES['2026-04-19-verified'])}[channel_idx + 1] channel, '2026-04-19-verified' montage_version, 'unknown' relabeled_from_version, count(*) n, round(avg(uv), 6) + 0.0 mean_uv from s group by all",
)
def b2(spark, sf):
    df = P.relabel(views.samples(spark, sf), "2026-04-19-verified")
    out = df.groupBy("session_id", "channel", "montage_version", "relabeled_from_version").agg(
        F.count(F.lit(1)).alias("n"), F.avg("uv").alias("mean_uv")
    )
    return pick(out, "session_id channel montage_version relabeled_from_version n mean_uv:6")


@query(
    "b3_channel_lookup",
    with_(S_SQL)
    + f"select session_id, channel_idx + 1 channel_no, channel as position, {_LIST(WIRE_COLORS)}[channel_idx % 8 + 1] wire_hex, case when channel_idx < 8 then 'main' else 'extension' end board, count(*) n from s group by all",
)
def b3(spark, sf):
    facts = P.with_channel_facts(views.samples(spark, sf))
    return (
        facts.withColumn("board", P.board_of(F.col("channel_no")))
        .groupBy("session_id", "channel_no", "position", "wire_hex", "board")
        .agg(F.count(F.lit(1)).alias("n"))
    )


_GROUPS_SQL = ", ".join(f"('{g}', '{c}')" for g, cs in CHANNEL_GROUPS.items() for c in cs)


@query(
    "b4_region_groups",
    with_(S_SQL)
    + f"select session_id, group_name, count(*) n, round(avg(uv), 6) + 0.0 mean_uv, round(stddev_pop(uv), 6) std_uv from s join (values {_GROUPS_SQL}) g(group_name, channel) using (channel) group by all",
)
def b4(spark, sf):
    out = P.with_groups(views.samples(spark, sf)).groupBy("session_id", "group_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("uv").alias("mean_uv"), F.stddev_pop("uv").alias("std_uv")
    )
    return pick(out, "session_id group_name n mean_uv:6 std_uv:6")


@query(
    "b5_channel_subset",
    with_(S_SQL) + f"select session_id, channel, sample_idx, round(uv, 6) + 0.0 uv from s where channel in {_IN(SUBSETS['8'])}",
)
def b5(spark, sf):
    return pick(P.channel_subset(views.samples(spark, sf), "8"), "session_id channel sample_idx uv:6")


@query(
    "b6_time_crop",
    with_(S_SQL) + "select session_id, channel, sample_idx, round(uv, 6) + 0.0 uv from s where sample_idx / 125.0 between 1.0 and 3.5",
)
def b6(spark, sf):
    return pick(P.crop(views.samples(spark, sf), 1.0, 3.5), "session_id channel sample_idx uv:6")


@query(
    "b7_latest_samples",
    with_(L_SQL)
    + "select session_id, channel_idx, sample_idx, uv from l qualify sample_idx > max(sample_idx) over (partition by session_id, channel_idx) - 20",
)
def b7(spark, sf):
    return P.latest(views.volume_samples(spark, sf), 20).select("session_id", "channel_idx", "sample_idx", "uv")


_CHUNK = "session_id channel_idx chunk_no n first_idx last_idx mean_uv:6"


@query(
    "b8_count_chunks",
    with_(S_SQL)
    + f"select {sel(_CHUNK)} from (select session_id, channel_idx, sample_idx // 256 chunk_no, count(*) n, min(sample_idx) first_idx, max(sample_idx) last_idx, avg(uv) mean_uv from s group by all) where n = 256",
)
def b8(spark, sf):
    return pick(P.full_chunks(views.samples(spark, sf)), _CHUNK)


@query(
    "b9_values_at_index",
    with_(S_SQL, encoded_sql()) + "select session_id, channel_idx, win sample_idx, round(a, 6) a, round(b, 6) b, round(c, 6) c from pns where win = 5",
)
def b9(spark, sf):
    pn = encode_sliding(views.samples(spark, sf), mode="per_channel").withColumnRenamed("win", "sample_idx")
    return pick(P.at_index(pn, 5), "session_id channel_idx sample_idx a:6 b:6 c:6")


_UV = "session_id channel sample_idx uv:6"


@query(
    "b10_overlay_sine",
    with_(S_SQL)
    + "select session_id, channel, sample_idx, round(uv + case when channel in ('O1','O2') then 20 * sin(2 * pi() * 10 * sample_idx / 125) else 0 end, 6) + 0.0 uv from s",
)
def b10(spark, sf):
    return pick(P.overlay_sine(views.samples(spark, sf), ["O1", "O2"]), _UV)


@query(
    "b11_overlay_bumps",
    with_(S_SQL, M_SQL)
    + """, pk as (select m.session_id, sample_index + 37 peak, n from m
         join (select session_id, max(sample_idx) + 1 n from s group by 1) using (session_id) where sample_index + 37 < n),
  bump as (select s.session_id, s.channel_idx, s.sample_idx, sum(10 * exp(-0.5 * pow((s.sample_idx - peak) / 12.0::double, 2))) v
           from s join pk on s.session_id = pk.session_id and s.sample_idx >= peak - 48 and s.sample_idx < peak + 48
           where channel in ('Pz','Cz') group by all)
  select session_id, channel, sample_idx, round(uv + coalesce(v, 0), 6) + 0.0 uv
  from s left join bump using (session_id, channel_idx, sample_idx)""",
)
def b11(spark, sf):
    return pick(P.overlay_bumps(views.samples(spark, sf), views.markers(spark, sf), ["Pz", "Cz"]), _UV)


@query(
    "b12_overlay_burst",
    with_(S_SQL)
    + """select session_id, channel, sample_idx, round(uv + case when channel in ('C3','C4') and sample_idx >= 900 and sample_idx < 900 + len
        then 5 * (0.5 - 0.5 * cos(2 * pi() * (sample_idx - 900) / (len - 1))) * sin(2 * pi() * 40 * (sample_idx - 900) / 125) else 0 end, 6) + 0.0 uv
      from s join (select session_id, least(max(sample_idx) + 1, 900 + 125) - 900 len from s group by 1) using (session_id)""",
)
def b12(spark, sf):
    return pick(P.overlay_burst(views.samples(spark, sf), ["C3", "C4"], 900, 125), _UV)


def components(spark, sf):
    """Component labels per user: one component per event type, with a confidence."""
    kinds = F.create_map(*[F.lit(v) for kv in _KINDS.items() for v in kv])
    v = F.col("value")
    return (
        views.table(spark, sf, "events")
        .groupBy(F.concat(F.lit("U"), F.col("user_id")).alias("session_id"), F.col("event_type"))
        .agg(F.avg(v / (v + 5)).alias("_p"), F.min("value").alias("_m"))
        .select(
            "session_id",
            F.array_position(F.array(*[F.lit(k) for k in _KINDS]), F.col("event_type")).cast("int").alias("component"),
            kinds[F.col("event_type")].alias("label"),
            F.when(F.col("_m") < 0.02, F.lit(float("nan"))).otherwise(F.col("_p")).alias("prob"),
        )
    )


_KINDS = {"click": "eye blink", "view": "brain", "error": "muscle artifact", "purchase": "line noise", "signup": "other"}
COMPONENTS_SQL = (
    "comp as (select 'U' || user_id session_id, list_position("
    + _LIST(_KINDS)
    + ", event_type)::int component, case event_type "
    + " ".join(f"when '{k}' then '{v}'" for k, v in _KINDS.items())
    + " end as label, case when min(value) < 0.02 then 'nan'::double else avg(value / (value + 5)) end prob from events group by user_id, event_type)"
)
_REJECTED = "comp where label in ('eye blink','muscle artifact','heart beat','line noise','channel noise','eye movement') and not isnan(prob) and prob >= 0.5"


@query("b13_artifact_components", with_(COMPONENTS_SQL) + f"select session_id, component, label, round(prob, 6) prob from {_REJECTED}")
def b13(spark, sf):
    return pick(P.artifact_components(components(spark, sf), 0.5), "session_id component label prob:6")


@query(
    "b14_default_spectrum_channels",
    with_(S_SQL)
    + """, p as (select distinct session_id, channel, channel_idx, nullif(list_position(['Oz','O2','O1','Pz','Cz'], channel), 0) pref from s)
  select session_id, channel, ord::int ord from (
    select *, row_number() over (partition by session_id order by coalesce(pref, channel_idx)) ord from (
      select *, max(pref is not null) over (partition by session_id) a from p) where pref is not null or not a) where ord <= 3""",
)
def b14(spark, sf):
    return P.default_spectrum_channels(views.samples(spark, sf))
