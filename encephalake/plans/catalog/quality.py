"""Signal quality: metrics, grading, log tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...dims import BENCH, CHANNEL_NAMES, GRADE_LIMITS, SUSPICIOUS
from ...functions.expr import channel_name
from ...operators import quality as Q
from ...sources import logs
from ...session import scratch_path
from .. import views
from .base import S_SQL, L_SQL, WIN_KEYS, pick, query, sel, windows_sql, with_
from .spectra import WKEYS, spans_full

_W = with_(S_SQL, windows_sql("wn"))


@query(
    "i1_railed_percent",
    _W + f"select {WIN_KEYS}, round(100.0 * avg((abs(uv - mu) > 100)::int), 6) rail_pct from (select *, avg(uv) over (partition by {WIN_KEYS}) mu from wn) group by all",
)
def i1(spark, sf):
    return pick(Q.rail_table(spans_full(spark, sf), WKEYS, 100.0), "session_id channel_idx win rail_pct:6")


@query("i2_channel_std", _W + f"select {WIN_KEYS}, round(stddev_pop(uv), 6) std_uv from wn group by all")
def i2(spark, sf):
    return pick(Q.std_table(spans_full(spark, sf), WKEYS), "session_id channel_idx win std_uv:6")


def notch_sql(n: int) -> str:
    """Impulse response of the 60 Hz notch, h(k) for k < n, and the filter's coefficients."""
    return f"""co as (select g, -2 * g * cos(w0) a1, 2 * g - 1 a2, -2 * g * cos(w0) b1 from (
    select w0, 1 / (1 + tan(w0 / 60)) g from (select 2 * pi() * 60 / 125 w0))),
  h as (with recursive r(k, y, y1) as (
      select 0, g, 0.0::double from co
      union all select k + 1, (case k + 1 when 1 then b1 when 2 then g else 0 end) - a1 * y - a2 * y1, y from r, co where k + 1 < {n})
    select k, y v from r)"""


_QUALITY_CTE = f"""lag_ as (select x.session_id, x.channel_idx, x.win, x.j, sum(h.v * y.uv) o
    from wn x join wn y on x.session_id = y.session_id and x.channel_idx = y.channel_idx and x.win = y.win and y.j <= x.j join h on h.k = x.j - y.j group by all),
  ql as (select {WIN_KEYS}, rail_pct, std_uv, greatest(0, least(1, 1 - pow(so / (std_uv + 1e-9), 2))) line_ratio from (
    select {WIN_KEYS}, 100.0 * avg((abs(uv - mu) > 500)::int) rail_pct, stddev_pop(uv) std_uv from (select *, avg(uv) over (partition by {WIN_KEYS}) mu from wn) group by all)
    join (select {WIN_KEYS}, stddev_pop(o) so from lag_ group by all) using ({WIN_KEYS}))"""


def status_sql(profile: str, quiet: bool = True) -> str:
    names, sides = {"rail": "rail_pct", "std": "std_uv", "line": "line_ratio"}, {"from": ">=", "above": ">", "below": "<"}
    limits = GRADE_LIMITS[profile].items()
    yellow, red = (" or ".join(f"{names[m]} {sides[side]} {at[k]}" for (m, side), at in limits) for k in (0, 1))
    if quiet:
        std, line, rail = SUSPICIOUS[profile]
        yellow += f" or (std_uv > {std} and line_ratio < {line} and rail_pct < {rail})"
    return f"case when {red} then 2 when {yellow} then 1 else 0 end"


def quality(spark, sf, **kw):
    return Q.sliding_quality(views.samples(spark, sf), **kw)


_SLIDE = with_(S_SQL, windows_sql("wn", hop=125), notch_sql(250), _QUALITY_CTE)


@query("i3_line_noise_ratio", _SLIDE + f"select {WIN_KEYS}, round(line_ratio, 6) line_ratio from ql")
def i3(spark, sf):
    return pick(quality(spark, sf), "session_id channel_idx win line_ratio:6")


_ALL_PROFILES = " union all ".join(
    f"select {WIN_KEYS}, '{n}' profile, ({status_sql(n)})::int status from ql" for n in GRADE_LIMITS
)


@query("i4_status_by_profile", _SLIDE + _ALL_PROFILES)
def i4(spark, sf):
    return Q.grade_all_profiles(quality(spark, sf).drop("status")).select(*WKEYS, "profile", "status")


_Q5 = "session_id channel_idx win rail_pct:6 std_uv:6 line_ratio:6 status"


@query("i5_sliding_quality", _SLIDE + f"select {sel(_Q5.replace(' status', ''))}, ({status_sql(BENCH)})::int status from ql")
def i5(spark, sf):
    return pick(quality(spark, sf), _Q5)


@query(
    "i6_board_check",
    with_(L_SQL)
    + "select session_id, channel_idx, round(std_uv, 6) std_uv, case when std_uv > 1 and std_uv < 500 then 'OK' when std_uv < 1 then 'FLAT' else 'NOISY' end as \"check\" from (select session_id, channel_idx, stddev_pop(uv) std_uv from l group by all)",
)
def i6(spark, sf):
    return pick(Q.board_check(views.volume_samples(spark, sf)), "session_id channel_idx std_uv:6 check")


# the log: quality rows written as text lines with their printed precision

_LOG_SQL = f"""lg as (select session_id, (win + 1)::double t, channel_idx, {"[" + ",".join(f"'{n}'" for n in CHANNEL_NAMES) + "]"}[channel_idx + 1] channel, win,
    round(rail_pct) rail_pct, round(std_uv, 1) std_uv, round(line_ratio * 100) / 100 line_ratio
  from ql join (select session_id, win from ql group by all having count(*) = 16) using (session_id, win)),
  log_ as (select *, ({status_sql(BENCH, False)})::int status from lg)"""
_LOG = _SLIDE + ", " + _LOG_SQL + " "


def log_lines(spark, sf):
    rows = quality(spark, sf).withColumn("channel", channel_name(F.col("channel_idx")))
    return logs.quality_lines(rows)


def log(spark, sf):
    return logs.parse_quality_lines(log_lines(spark, sf), CHANNEL_NAMES)


_LOGCOLS = "session_id t channel rail_pct std_uv line_ratio"


@query("i7_log_status", _LOG + "select session_id, t, channel, status from log_")
def i7(spark, sf):
    return log(spark, sf).select("session_id", "t", "channel", "status")


@query("a8_parse_quality_log", _LOG + f"select {sel(_LOGCOLS)}, status from log_")
def a8(spark, sf):
    path = scratch_path(spark, "quality-log")
    log_lines(spark, sf).select("session_id", "value").write.partitionBy("session_id").text(path)
    parsed = logs.parse_quality_lines(spark.read.schema("value string, session_id string").text(path), CHANNEL_NAMES)
    return parsed.select(*_LOGCOLS.split(), "status")


_I8 = "session_id channel pct_green:4 pct_yellow:4 pct_red:4 min_std:4 med_std:4 med_line:4 med_rail:4"


@query(
    "i8_channel_summary",
    _LOG
    + """, z as (select session_id, channel, 100.0 * avg((status = 0)::int) pct_green, 100.0 * avg((status = 1)::int) pct_yellow, 100.0 * avg((status = 2)::int) pct_red,
     coalesce(min(std_uv) filter (std_uv > 1), 0) min_std, quantile_cont(std_uv, 0.5) med_std, 100 * quantile_cont(line_ratio, 0.5) med_line, quantile_cont(rail_pct, 0.5) med_rail from log_ group by all) """
    + f"select {sel(_I8)} from z",
)
def i8(spark, sf):
    return pick(Q.channel_summary(log(spark, sf)), _I8)


@query(
    "i9_std_correlation",
    _LOG
    + """, c as (select *, least(std_uv, 2000) v from log_)
  select a.session_id, a.channel_idx ch_i, b.channel_idx ch_j, round(corr(a.v, b.v), 5) corr from c a join c b on a.session_id = b.session_id and a.t = b.t and a.channel_idx < b.channel_idx group by all""",
)
def i9(spark, sf):
    return pick(Q.std_correlation(log(spark, sf)), "session_id ch_i ch_j corr:5")


@query(
    "i10_contact_changes",
    _LOG
    + """, d as (select session_id, win, t, sum(d) total_change from (select *, abs(least(std_uv, 2000) - lag(least(std_uv, 2000)) over (partition by session_id, channel_idx order by win)) d from log_) group by all having sum(d) is not null)
  select session_id, t, round(total_change, 4) total_change from d qualify total_change > quantile_cont(total_change, 0.9) over (partition by session_id)""",
)
def i10(spark, sf):
    rows = log(spark, sf).withColumn("step", F.col("t").cast("bigint") - 1)
    return pick(Q.contact_changes(rows), "session_id t total_change:4")


_I11 = "session_id t board " + " ".join(f"{m}_{q}:4" for m in ("std", "line", "rail") for q in ("med", "q25", "q75"))


@query(
    "i11_board_comparison",
    _LOG
    + ", z as (select session_id, t, case when channel_idx < 8 then 'main' else 'extension' end board, "
    + ", ".join(
        f"quantile_cont({e}, {p}) {m}_{q}"
        for m, e in (("std", "least(std_uv, 2000)"), ("line", "100 * line_ratio"), ("rail", "rail_pct"))
        for q, p in (("med", 0.5), ("q25", 0.25), ("q75", 0.75))
    )
    + f" from log_ group by all) select {sel(_I11)} from z",
)
def i11(spark, sf):
    return pick(Q.board_comparison(log(spark, sf)), _I11)


@query(
    "i12_metric_grid",
    _LOG + "select session_id, t, " + ", ".join(f"max(least(std_uv, 2000)) filter (channel = '{c}') {c}" for c in CHANNEL_NAMES) + " from log_ group by all",
)
def i12(spark, sf):
    return Q.metric_grid(log(spark, sf), CHANNEL_NAMES)


# ---------------------------------------------------------------- optional items


@query("p1_rms_light", _W + """select session_id, channel_idx, win, round(sqrt(avg(uv * uv)), 6) rms,
   (case when sqrt(avg(uv * uv)) < 0.5 or sqrt(avg(uv * uv)) > 100 then 2 when sqrt(avg(uv * uv)) between 1 and 30 then 0 else 1 end) light from wn group by all""")
def p1(spark, sf):
    return pick(Q.rms_light(spans_full(spark, sf), WKEYS), "session_id channel_idx win rms:6 light")


@query(
    "p2_single_bin_amplitude",
    _W
    + """select session_id, channel_idx, win, round(a, 6) amplitude_uv, round(a / 6, 6) impedance_kohm from (
    select session_id, channel_idx, win, 2 * sqrt(pow(sum(uv * cos(2 * pi() * 31.25 * j / 125)), 2) + pow(sum(uv * sin(2 * pi() * 31.25 * j / 125)), 2)) / count(*) a from wn group by all)""",
)
def p2(spark, sf):
    return pick(Q.single_bin_amplitude(spans_full(spark, sf), WKEYS), "session_id channel_idx win amplitude_uv:6 impedance_kohm:6")
