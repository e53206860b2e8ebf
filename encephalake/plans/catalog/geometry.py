"""Covariances, their geometry, and source separation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...dims import EOG_PROXIES
from ...functions.iterate import matrix_sums
from ...operators import geometry as G
from ...operators import separation as H
from ...operators import signal as C
from ...operators import windows as W
from .. import views
from .base import M_SQL, S_SQL, STATES_SQL, pick, query, with_, windows_sql
from .windows import OPEN_CLOSED, intervals

_OUT = "session_id win center_sec ch_i ch_j value:3"
_FULL = (
    windows_sql("wn")
    + """, full_ as (select session_id, win from wn group by all having count(*) = 16 * 250),
  ce as (select wn.session_id, win, channel_idx, j, uv - avg(uv) over (partition by wn.session_id, wn.channel_idx, wn.win) x from wn join full_ using (session_id, win)),
  cv as (select a.session_id, a.win, a.channel_idx ch_i, b.channel_idx ch_j, sum(a.x * b.x) / 250 s, sum(a.x * a.x * b.x * b.x) / 250 s4
         from ce a join ce b on a.session_id = b.session_id and a.win = b.win and a.j = b.j group by all)"""
)
_SELECT = " select session_id, win, (win * 250 + 125.0::double) / 125 center_sec, ch_i, ch_j, round({v}, 3) + 0.0 as value from {t} where ch_i <= ch_j"


def covs(spark, sf, method="oas", overlap=0.0, n_channels=16):
    samples = views.samples(spark, sf).where(F.col("channel_idx") < n_channels)
    return G.covariance_matrices(samples, method=method, overlap=overlap, n_channels=n_channels)


@query("g1_covariance_empirical", with_(S_SQL, _FULL) + _SELECT.format(v="s", t="cv"))
def g1(spark, sf):
    return pick(G.covariance_entries(covs(spark, sf, "empirical")), _OUT)


_TRACE = "tr as (select session_id, win, sum(s) filter (ch_i = ch_j) / 16 mu, sum(s * s) ss, sum(s4) s4 from cv group by all)"


@query(
    "g2_covariance_oas",
    with_(S_SQL, _FULL, _TRACE)
    + """, sh as (select *, case when ss / 256 - mu * mu / 16 = 0 then 1 else least(1, (ss / 256 + mu * mu) / (251 * (ss / 256 - mu * mu / 16))) end rho from tr),
    o as (select cv.session_id, cv.win, ch_i, ch_j, (1 - rho) * s + (case when ch_i = ch_j then rho * mu else 0 end) v from cv join sh using (session_id, win))"""
    + _SELECT.format(v="v", t="o"),
)
def g2(spark, sf):
    return pick(G.covariance_entries(covs(spark, sf)), _OUT)


@query(
    "g3_covariance_ledoit_wolf",
    with_(S_SQL, _FULL, _TRACE)
    + """, db as (select *, (ss - 2 * mu * 16 * mu + 16 * mu * mu) / 16 delta, (s4 - ss) / (16 * 250) beta from tr),
    sh as (select *, case when beta = 0 then 0 else least(beta, delta) / delta end rho from db),
    o as (select cv.session_id, cv.win, ch_i, ch_j, (1 - rho) * s + (case when ch_i = ch_j then rho * mu else 0 end) v from cv join sh using (session_id, win))"""
    + _SELECT.format(v="v", t="o"),
)
def g3(spark, sf):
    return pick(G.covariance_entries(covs(spark, sf, "lw")), _OUT)


@query("g4_spd_check", with_(S_SQL, _FULL) + "select session_id, win, true as is_spd from full_")
def g4(spark, sf):
    return G.spd_check(covs(spark, sf)).select("session_id", "win", "is_spd")


def grouped(spark, sf, n_channels=16):
    """Covariances at 50 % overlap, tagged open or closed through the state markers."""
    tagged = W.assign_states(covs(spark, sf, overlap=0.5, n_channels=n_channels), intervals(spark, sf))
    return W.merge_states(tagged, OPEN_CLOSED)


def flat(df, value):
    return df.select(
        *[c for c in df.columns if c != value], F.posexplode(value).alias("p", "value")
    )


@query("g5_frechet_mean")
def g5(spark, sf):
    means = G.frechet_means(grouped(spark, sf), ["session_id", "state_group"])
    return pick(flat(means, "mean"), "session_id state_group p value:4")


@query("g6_tangent_vectors")
def g6(spark, sf):
    data = covs(spark, sf)
    sums = matrix_sums(data, ["session_id"], "cov")
    base = sums.select("session_id", F.transform("total", lambda e: e / F.col("n")).alias("base"))
    out = G.tangent_vectors(data.join(base, "session_id"), "base", "cov")
    return pick(flat(out.select("session_id", "win", "tangent"), "tangent"), "session_id win p value:4")


def two_states(spark, sf, n_channels=16):
    return G.state_means(grouped(spark, sf, n_channels), ["session_id"], "state_group", "open", "closed")


@query("g7_polarity_projection")
def g7(spark, sf):
    out = G.polarity(G.reference_direction(two_states(spark, sf)))
    return pick(out, "session_id sign magnitude:4 projection:4")


@query("g8_reference_direction")
def g8(spark, sf):
    out = G.reference_direction(two_states(spark, sf)).select("session_id", "reference")
    return pick(flat(out, "reference"), "session_id p value:6")


# Two channels: roots and logarithms of 2 x 2 matrices (a, b; b, c) have closed forms, so SQL follows every step.


def _sandwich(h: str, m: str) -> list[str]:
    """Entries of H M H for symmetric H and M with columns h1..h3 and m1..m3."""
    h1, h2, h3, a, b, c = (f"{x}{i}" for x in (h, m) for i in (1, 2, 3))
    return [
        f"{h1} * {h1} * {a} + 2 * {h1} * {h2} * {b} + {h2} * {h2} * {c}",
        f"{h1} * {h2} * {a} + ({h1} * {h3} + {h2} * {h2}) * {b} + {h2} * {h3} * {c}",
        f"{h2} * {h2} * {a} + 2 * {h2} * {h3} * {b} + {h3} * {h3} * {c}",
    ]


def _three(values: list[str], name: str) -> str:
    return ", ".join(f"{v} {name}{i}" for i, v in enumerate(values, 1))


def _root(m: str, name: str, source: str) -> str:
    """``source`` with the square root of m1..m3 as name1..name3."""
    return f"""(select *, ({m}1 + {name}s) / {name}t {name}1, {m}2 / {name}t {name}2, ({m}3 + {name}s) / {name}t {name}3 from (
      select *, sqrt({m}1 + {m}3 + 2 * {name}s) {name}t from (select *, sqrt({m}1 * {m}3 - {m}2 * {m}2) {name}s from {source})))"""


def _log(m: str, name: str, source: str) -> str:
    """``source`` with the logarithm of m1..m3 as name1..name3."""
    return f"""(select *, {name}f * ({m}1 - {name}v) + ln({name}v) {name}1, {name}f * {m}2 {name}2, {name}f * ({m}3 - {name}v) + ln({name}v) {name}3 from (
      select *, case when {name}u = {name}v then 1 / {name}u else (ln({name}u) - ln({name}v)) / ({name}u - {name}v) end {name}f from (
        select *, ({m}1 + {m}3) / 2 + {name}d {name}u, ({m}1 + {m}3) / 2 - {name}d {name}v from (
          select *, sqrt(({m}1 - {m}3) * ({m}1 - {m}3) / 4 + {m}2 * {m}2) {name}d from {source}))))"""


def _log_map(base: str, point: str, name: str, source: str) -> str:
    """``source`` with the tangent vector at base1..3 towards point1..3 as name1..name3."""
    rooted = _root(base, f"{name}r", source)
    r = f"{name}r"
    inverse = f"(select *, {r}3 / {name}e {name}i1, -{r}2 / {name}e {name}i2, {r}1 / {name}e {name}i3 from (select *, {r}1 * {r}3 - {r}2 * {r}2 {name}e from {rooted}))"
    inner = f"(select *, {_three(_sandwich(f'{name}i', point), f'{name}y')} from {inverse})"
    logged = _log(f"{name}y", f"{name}l", inner)
    return f"(select *, {_three(_sandwich(r, f'{name}l'), name)} from {logged})"


_TWO = (
    "recursive " + S_SQL + ",\n" + M_SQL + ",\n" + STATES_SQL
    + ", s2 as (select * from s where channel_idx < 2), " + windows_sql("wn", "s2", hop=125)
    + f""", ce as (select *, uv - avg(uv) over (partition by session_id, channel_idx, win) x from wn),
  cv as (select a.session_id, a.win, sum(a.x * a.x) / 250 p, sum(a.x * b.x) / 250 q, sum(b.x * b.x) / 250 r
         from ce a join ce b on a.session_id = b.session_id and a.win = b.win and a.j = b.j and a.channel_idx = 0 and b.channel_idx = 1 group by all having count(*) = 250),
  mu as (select *, (p + r) / 2 mu, (p * p + 2 * q * q + r * r) / 4 al from cv),
  rh as (select *, case when al - mu * mu / 2 = 0 then 1 else least(1, (al + mu * mu) / (251 * (al - mu * mu / 2))) end rho from mu),
  oc as (select session_id, win, (1 - rho) * p + rho * mu c1, (1 - rho) * q c2, (1 - rho) * r + rho * mu c3 from rh),
  gc as (select oc.*, case when right(label, 1)::int % 2 = 0 then 'open' else 'closed' end grp
         from oc join iv on oc.session_id = iv.session_id and (win * 125 + 125.0::double) / 125 >= onset_sec and (win * 125 + 125.0::double) / 125 < end_sec),
  gp as (select session_id, grp, c1, c2, c3 from gc union all select session_id, 'pooled', c1, c2, c3 from gc),
  fm(session_id, grp, it, m1, m2, m3) as (
    select session_id, grp, 0, avg(c1), avg(c2), avg(c3) from gp group by all
    union all
    select session_id, grp, it + 1, avg(w1), avg(w2), avg(w3) from {_root("x", "w", "(select *, " + _three(_sandwich("h", "c"), "x") + " from " + _root("m", "h", "(select fm.*, c1, c2, c3 from fm join gp using (session_id, grp) where it < 50)") + ")")}
    group by session_id, grp, it),
  me as (select * from fm where it = 50),
  st as (select session_id, max(m1) filter (grp = 'open') a1, max(m2) filter (grp = 'open') a2, max(m3) filter (grp = 'open') a3,
      max(m1) filter (grp = 'closed') b1, max(m2) filter (grp = 'closed') b2, max(m3) filter (grp = 'closed') b3,
      max(m1) filter (grp = 'pooled') o1, max(m2) filter (grp = 'pooled') o2, max(m3) filter (grp = 'pooled') o3 from me group by 1),
  df as (select *, lb1 - la1 d1, lb2 - la2 d2, lb3 - la3 d3 from {_log("b", "lb", _log("a", "la", "st"))}),
  ev as (select *, (d1 + d3) / 2 + e u, (d1 + d3) / 2 - e v from (select *, sqrt((d1 - d3) * (d1 - d3) / 4 + d2 * d2) e from df)),
  rf as (select *, case when abs(u) >= abs(v) then (d1 - v) / (u - v) else (d1 - u) / (v - u) end r1, case when abs(u) >= abs(v) then d2 / (u - v) else d2 / (v - u) end r2,
      case when abs(u) >= abs(v) then (d3 - v) / (u - v) else (d3 - u) / (v - u) end r3 from ev)"""
)
_ENTRIES = "select {keys}, p, round(list_extract([{n}1, {n}2, {n}2, {n}3], p + 1), {digits}) + 0.0 as value from {t}, (select unnest(range(4))::int p)"


@query("g5_frechet_mean_2", "with " + _TWO + " " + _ENTRIES.format(keys="session_id, grp as state_group", n="m", digits=4, t="me") + " where grp <> 'pooled'")
def g5_two(spark, sf):
    means = G.frechet_means(grouped(spark, sf, 2), ["session_id", "state_group"])
    return pick(flat(means, "mean"), "session_id state_group p value:4")


@query(
    "g6_tangent_vectors_2",
    "with " + _TWO
    + ", ba as (select session_id, avg(c1) m1, avg(c2) m2, avg(c3) m3 from oc group by 1), tg as (select * from "
    + _log_map("m", "c", "t", "(select oc.*, m1, m2, m3 from oc join ba using (session_id))")
    + ") " + _ENTRIES.format(keys="session_id, win", n="t", digits=4, t="tg"),
)
def g6_two(spark, sf):
    data = covs(spark, sf, overlap=0.5, n_channels=2)
    sums = matrix_sums(data, ["session_id"], "cov")
    base = sums.select("session_id", F.transform("total", lambda e: e / F.col("n")).alias("base"))
    out = G.tangent_vectors(data.join(base, "session_id"), "base", "cov")
    return pick(flat(out.select("session_id", "win", "tangent"), "tangent"), "session_id win p value:4")


@query(
    "g7_polarity_projection_2",
    "with " + _TWO + ", tb as (select * from " + _log_map("o", "b", "tb", "rf") + "), ta as (select * from " + _log_map("o", "a", "ta", "tb")
    + """), pr as (select session_id, ((tb1 - ta1) * r1 + 2 * (tb2 - ta2) * r2 + (tb3 - ta3) * r3) / sqrt(r1 * r1 + 2 * r2 * r2 + r3 * r3) v from ta)
  select session_id, sign(v)::int sign, round(abs(v), 4) + 0.0 magnitude, round(v, 4) + 0.0 projection from pr""",
)
def g7_two(spark, sf):
    out = G.polarity(G.reference_direction(two_states(spark, sf, 2)))
    return pick(out, "session_id sign magnitude:4 projection:4")


@query("g8_reference_direction_2", "with " + _TWO + " " + _ENTRIES.format(keys="session_id", n="r", digits=6, t="rf"))
def g8_two(spark, sf):
    out = G.reference_direction(two_states(spark, sf, 2)).select("session_id", "reference")
    return pick(flat(out, "reference"), "session_id p value:6")


# ---------------------------------------------------------------- separation


def fitted(spark, sf):
    return H.fit_ica(C.highpass(views.samples(spark, sf)))


@query("h1_fit_components")
def h1(spark, sf):
    ica = fitted(spark, sf)
    return ica.select("session_id", F.posexplode("unmixing").alias("p", "weight"))


@query("h2_flag_eye_components")
def h2(spark, sf):
    return H.flag_eye_components(views.samples(spark, sf), fitted(spark, sf))


@query(
    "h3_apply_matrix",
    with_(S_SQL)
    + """, f as (select *, count(*) over (partition by session_id, sample_idx) c, avg(uv) over (partition by session_id, sample_idx) m from s)
    select session_id, sample_idx, channel_idx, round(case when c = 16 then uv - m else uv end, 6) + 0.0 uv, c = 16 complete from f""",
)
def h3(spark, sf):
    """A given matrix: re-reference every complete time point to the channel mean; others stay as they are."""
    data = views.samples(spark, sf)
    eye = [[(1.0 if i == j else 0.0) - 1 / 16 for j in range(16)] for i in range(16)]
    matrices = data.select("session_id").distinct().select(
        "session_id",
        F.array(*[F.lit(v) for row in eye for v in row]).alias("m"),
        F.array_repeat(F.lit(0.0), 16).alias("shift"),
    )
    return pick(H.apply_matrices(data, matrices), "session_id sample_idx channel_idx uv:6 complete")


@query("h3_remove_components")
def h3_remove(spark, sf):
    data = views.samples(spark, sf)
    ica = fitted(spark, sf)
    scores = H.flag_eye_components(data, ica)
    worst = scores.groupBy("session_id").agg(F.max_by("component", F.abs("score")).alias("component"))
    return pick(H.apply_matrices(data, H.cleaning_matrices(ica, worst)), "session_id sample_idx channel_idx uv:4 complete")


# What a fit must satisfy, recomputed from its output: SQL states the value, the samples decide.
_SESSIONS = with_(S_SQL) + ", q as (select session_id, count(*) n from s group by 1) "


@query(
    "h1_unmixing_whitens",
    _SESSIONS + "select session_id, i::int i, j::int j, case when i = j then 1.0::double else 0.0::double end value from q, (select unnest(range(15)) i), (select unnest(range(15)) j) where i <= j",
)
def h1_whitens(spark, sf):
    """Covariances of the components' time courses: the identity, whatever the data."""
    data = C.highpass(views.samples(spark, sf))
    y = H.activations(data, fitted(spark, sf))
    pairs = y.toDF("session_id", "sample_idx", "i", "x").join(y.toDF("session_id", "sample_idx", "j", "y"), ["session_id", "sample_idx"]).where("i <= j")
    return pick(pairs.groupBy("session_id", "i", "j").agg(F.covar_pop("x", "y").alias("value")), "session_id i j value:4")


@query("h2_scores_are_correlations", _SESSIONS + "select session_id, component::int component, 0.0::double difference from q, (select unnest(range(15)) component)")
def h2_recomputed(spark, sf):
    """Each score against the largest correlation of the component's time course with a proxy channel."""
    data = views.samples(spark, sf)
    ica = fitted(spark, sf)
    scores = H.flag_eye_components(data, ica)
    proxies = data.where(F.col("channel").isin(list(EOG_PROXIES))).select("session_id", "sample_idx", "channel", "uv")
    r = H.activations(data, ica).join(proxies, ["session_id", "sample_idx"]).groupBy("session_id", "component", "channel").agg(F.corr("value", "uv").alias("r"))
    best = r.groupBy("session_id", "component").agg(F.max_by("r", F.abs("r")).alias("best"))
    return pick(scores.join(best, ["session_id", "component"]).withColumn("difference", F.abs(F.col("score")) - F.abs("best")), "session_id component difference:6")


@query(
    "h3_removal_is_exact",
    with_(S_SQL)
    + """, f as (select *, count(*) over (partition by session_id, sample_idx) c from s)
  select session_id, count(*) n, count(*) filter (c = 16) n_complete, 0.0::double left_of_removed, 0.0::double change_of_others, 0.0::double change_of_incomplete from f group by 1""",
)
def h3_exact(spark, sf):
    """After removal the removed component is flat, the others are as before, incomplete points untouched."""
    data = views.samples(spark, sf)
    ica = fitted(spark, sf)
    worst = H.flag_eye_components(data, ica).groupBy("session_id").agg(F.max_by("component", F.abs("score")).alias("component"))
    cleaned = H.apply_matrices(data, H.cleaning_matrices(ica, worst))
    at = ["session_id", "sample_idx", "component"]
    both = H.activations(data, ica).join(H.activations(cleaned.drop("complete"), ica).withColumnRenamed("value", "now"), at)
    both = both.join(worst.select("session_id", F.col("component").alias("gone")), "session_id")
    gone = F.col("component") == F.col("gone")
    facts = both.groupBy("session_id").agg(
        F.max(F.when(gone, F.abs("now"))).alias("left_of_removed"), F.max(F.when(~gone, F.abs(F.col("now") - F.col("value")))).alias("change_of_others")
    )
    key = ["session_id", "sample_idx", "channel_idx"]
    rows = cleaned.join(data.select(*key, F.col("uv").alias("was")), key).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("complete").alias("n_complete"), F.coalesce(F.max(F.when(~F.col("complete"), F.abs(F.col("uv") - F.col("was")))), F.lit(0.0)).alias("change_of_incomplete")
    )
    return pick(facts.join(rows, "session_id"), "session_id n n_complete left_of_removed:6 change_of_others:6 change_of_incomplete:6")
