"""Filters, envelopes, phase, state equations, epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import kernels
from ...operators import signal as C
from ...operators.windows import assign_windows
from .. import views
from .base import CROP, CROPPED_SQL, GAP, GAPPED_SQL, L_SQL, M_SQL, S_SQL, pick, query, sel, with_
from .quality import notch_sql

_CH = "session_id, channel_idx"
_OUT = "session_id channel_idx sample_idx uv:5"


def lowpass_sql(name: str, cutoff: float, n: int) -> str:
    """Unit-gain Hamming-windowed sinc as (k, v)."""
    return f"""{name} as (select k, v / sum(v) over () v from (select k, (0.54 - 0.46 * cos(2 * pi() * k / {n - 1})) *
      case when 2 * k = {n - 1} then 1 else sin(pi() * u) / (pi() * u) end v from (select k, {2 * cutoff / 125!r}::double * (k - {(n - 1) / 2}) u from (select unnest(range({n})) k))))"""


def fir_sql(name: str, source: str, taps: str, half: int) -> str:
    """Zero-phase filtering with point-reflected ends of every channel."""
    return f"""{name}_e as (select {_CH}, max(sample_idx) n1, arg_min(uv, sample_idx) x0, arg_max(uv, sample_idx) xn from {source} group by all),
  {name}_p as (select t.session_id, t.channel_idx, unnest([sample_idx, case when sample_idx between 1 and {half} then -sample_idx end, case when sample_idx between n1 - {half} and n1 - 1 then 2 * n1 - sample_idx end]) i,
      unnest([uv, 2 * x0 - uv, 2 * xn - uv]) v, n1 from {source} t join {name}_e using (session_id, channel_idx)),
  {name} as (select session_id, channel_idx, i - {half} + k sample_idx, sum({taps}.v * p.v) uv from {name}_p p, {taps} where i is not null and i - {half} + k between 0 and n1 group by all)"""


_NOTCH = [
    lowpass_sql("na", 58.75, 825), lowpass_sql("nb", 61.25, 825),
    "nt as (select k, na.v - nb.v + (case when k = 412 then 1 else 0 end) v from na join nb using (k))",
]
_BAND = [
    lowpass_sql("la", 0.25, 825), lowpass_sql("lb", 56.25, 33),
    "bt as (select la.k, coalesce(lb.v, 0) - la.v v from la left join lb on lb.k = la.k - 396)",
]
_HIGH = [lowpass_sql("ha", 0.5, 413), "ht as (select k, (case when k = 206 then 1 else 0 end) - v v from ha)"]


@query("c1_notch_filter", with_(S_SQL, *_NOTCH, fir_sql("y", "s", "nt", 412)) + f"select {sel(_OUT)} from y")
def c1(spark, sf):
    return pick(C.notch(views.samples(spark, sf)), _OUT)


@query("c2_bandpass_filter", with_(S_SQL, *_BAND, fir_sql("y", "s", "bt", 412)) + f"select {sel(_OUT)} from y")
def c2(spark, sf):
    return pick(C.bandpass(views.samples(spark, sf)), _OUT)


def iir_taps_sql(name: str, low: float, high: float) -> tuple[str, int]:
    """Zero-phase taps as (k, v), and how many there are on a side: the autocorrelation of the sections' impulse response."""
    sections = kernels.butterworth_sections(low, high, 125.0)
    n = max(kernels.decay_length(a, 1e-14) for _, a in sections)
    states = [f"z{j}{i}" for j in range(1, len(sections) + 1) for i in (1, 2)]
    source = f"select i + 1 i, (case when i = -1 then 1 else 0 end)::double v0, {', '.join(states)} from {name}_h where i < {n}"
    after = []
    for j, (b, a) in enumerate(sections, 1):
        b, a = [f"{x!r}::double" for x in b.tolist()], [f"{x!r}::double" for x in a.tolist()]
        source = f"select *, {b[0]} * v{j - 1} + z{j}1 v{j} from ({source})"
        after += [f"{b[1]} * v{j - 1} - {a[1]} * v{j} + z{j}2", f"{b[2]} * v{j - 1} - {a[2]} * v{j}"]
    sql = f"""{name}_h(i, h, {', '.join(states)}) as (select -1, 0::double, {', '.join(['0::double'] * len(states))}
    union all select i, v{len(sections)}, {', '.join(after)} from ({source})),
  {name}_r as (select b.i - a.i m, sum(a.h * b.h) v from {name}_h a join {name}_h b on b.i >= a.i where a.i >= 0 group by 1),
  {name} as (select {n} + m k, v from {name}_r union all select {n} - m, v from {name}_r where m > 0)"""
    return sql, n


_IIR, _IIR_HALF = iir_taps_sql("it", 0.5, 50.0)


@query("c2_bandpass_iir", "with recursive " + S_SQL + ", " + _IIR + ", " + fir_sql("y", "s", "it", _IIR_HALF) + f" select {sel(_OUT)} from y")
def c2_iir(spark, sf):
    return pick(C.bandpass(views.samples(spark, sf), method="iir"), _OUT)


@query(
    "c3_preprocess_chain",
    with_(S_SQL, *_NOTCH, *_BAND, fir_sql("x", "s", "nt", 412), fir_sql("y", "x", "bt", 412)) + f"select {sel(_OUT)} from y",
)
def c3(spark, sf):
    return pick(C.preprocess(views.samples(spark, sf)), _OUT)


def cropped(spark, sf):
    return views.samples(spark, sf).where(F.col("sample_idx") >= CROP)


@query(
    "c1_gapped_notch",
    with_(GAPPED_SQL, *_NOTCH, fir_sql("y", "s", "nt", 412))
    + "select split_part(session_id, '#', 1) session_id, channel_idx, sample_idx + split_part(session_id, '#', 2)::bigint sample_idx, round(uv, 5) + 0.0 as uv from y",
)
def c1_gapped(spark, sf):
    """Both sides of a gap are filtered on their own and keep their indexes."""
    return pick(C.notch(views.samples(spark, sf).where(~F.col("sample_idx").between(*GAP))), _OUT)


@query(
    "c3_cropped_preprocess",
    with_(CROPPED_SQL, *_NOTCH, *_BAND, fir_sql("x", "s", "nt", 412), fir_sql("y", "x", "bt", 412)) + f"select session_id, channel_idx, sample_idx + {CROP} sample_idx, round(uv, 5) + 0.0 as uv from y",
)
def c3_cropped(spark, sf):
    """A recording that starts late is preprocessed as one that starts at 0."""
    return pick(C.preprocess(cropped(spark, sf)), _OUT)


@query(
    "c4_causal_notch",
    with_(S_SQL, notch_sql(900))
    + "select s.session_id, s.channel_idx, s.sample_idx + k sample_idx, round(sum(s.uv * h.v), 5) + 0.0 uv from s join (select session_id, channel_idx, max(sample_idx) n1 from s group by all) e using (session_id, channel_idx), h where s.sample_idx + k <= n1 group by all",
)
def c4(spark, sf):
    return pick(C.iir_notch(views.samples(spark, sf)), _OUT)


@query("c5_highpass_filter", with_(S_SQL, *_HIGH, fir_sql("y", "s", "ht", 206)) + f"select {sel(_OUT)} from y")
def c5(spark, sf):
    return pick(C.highpass(views.samples(spark, sf)), _OUT)


def rms_sql(source: str) -> str:
    return f"rm as (select {_CH}, sample_idx, sqrt(sum(uv * uv) over (partition by {_CH} order by sample_idx rows between 6 preceding and 5 following) / 12) rms from {source})"


_MINMAX = f"dr as (select {_CH}, sample_idx, (rms - min(rms) over (partition by {_CH})) / (max(rms) over (partition by {_CH}) - min(rms) over (partition by {_CH}) + 1e-10) f from rm)"


@query("c6_rms_envelope", with_(L_SQL, rms_sql("l")) + "select session_id, channel_idx, sample_idx, round(rms, 6) rms from rm")
def c6(spark, sf):
    return pick(C.rms_envelope(views.volume_samples(spark, sf)), "session_id channel_idx sample_idx rms:6")


@query("c7_normalise_minmax", with_(S_SQL, rms_sql("s"), _MINMAX) + "select session_id, channel_idx, sample_idx, round(f, 6) f from dr")
def c7(spark, sf):
    return pick(C.normalise(C.rms_envelope(views.samples(spark, sf))), "session_id channel_idx sample_idx f:6")


@query(
    "c7_normalise_sigmoid",
    with_(S_SQL, rms_sql("s"))
    + f"select {_CH}, sample_idx, round(1 / (1 + exp(-(rms - avg(rms) over (partition by {_CH})) / (stddev_pop(rms) over (partition by {_CH}) + 1e-10))), 6) f from rm",
)
def c7z(spark, sf):
    return pick(C.normalise(C.rms_envelope(views.samples(spark, sf)), "zscore"), "session_id channel_idx sample_idx f:6")


_PHASE = f"""nn as (select {_CH}, count(*) n from s group by all),
  ft as (select s.session_id, s.channel_idx, n, k, sum(uv * cos(2 * pi() * ((k * sample_idx) % n) / n)) re, -sum(uv * sin(2 * pi() * ((k * sample_idx) % n) / n)) im
         from s join nn using (session_id, channel_idx) join (select unnest(range(513)) k) on 2 * k <= n group by all),
  an as (select {_CH}, i sample_idx, sum(g * (re * cos(t) - im * sin(t))) zr, sum(g * (re * sin(t) + im * cos(t))) zi from (
         select {_CH}, i, re, im, case when k = 0 or 2 * k = n then 1 else 2 end g, 2 * pi() * ((k * i) % n) / n t from ft, (select unnest(range(1024)) i) where i < n) group by all),
  ph as (select {_CH}, sample_idx, case when atan2(zi, zr) < 0 then atan2(zi, zr) + 2 * pi() else atan2(zi, zr) end b from an)"""
_PHASE_OUT = "session_id channel_idx sample_idx cos_b:5 sin_b:5"


@query(
    "c8_instantaneous_phase",
    with_(S_SQL, _PHASE) + "select session_id, channel_idx, sample_idx, round(cos(b), 5) + 0.0 cos_b, round(sin(b), 5) + 0.0 sin_b from ph",
)
def c8(spark, sf):
    out = C.instantaneous_phase(views.samples(spark, sf))
    return pick(out.withColumn("cos_b", F.cos("b")).withColumn("sin_b", F.sin("b")), _PHASE_OUT)


def scan_sql(ma: str, qa: str, mc: str, qc: str, source: str = "st") -> str:
    """Both states from their affine steps: y = P (y0 + sum q / P), P the running product."""
    return f"""mp as (select {_CH}, sample_idx, {ma} ma, {qa} qa, {mc} mc, {qc} qc from {source}),
  pr as (select *, exp(sum(case when sample_idx = 0 then 0 else ln(ma) end) over w) pa, exp(sum(case when sample_idx = 0 then 0 else ln(mc) end) over w) pc from mp
         window w as (partition by {_CH} order by sample_idx rows unbounded preceding)),
  ac as (select {_CH}, sample_idx, greatest(0, least(1, pa * (0.5 + sum(case when sample_idx = 0 then 0 else qa / pa end) over w))) a,
         greatest(0, least(1, pc * (0.5 + sum(case when sample_idx = 0 then 0 else qc / pc end) over w))) c from pr
         window w as (partition by {_CH} order by sample_idx rows unbounded preceding))"""


_DRIVE = with_(S_SQL, rms_sql("s"), _MINMAX, f"st as (select *, lag(f) over (partition by {_CH} order by sample_idx) f0, f f1 from dr)")
_EULER = scan_sql("1 + 0.008::double * (-0.1 - f0)", "0.008::double * f0", "1 + 0.008::double * (0.05 - f0)", "0.008::double * f0")
_AC = "session_id channel_idx sample_idx a:6 c:6"


def drive(spark, sf):
    return C.normalise(C.rms_envelope(views.samples(spark, sf)))


@query("c9_states_euler", _DRIVE + ", " + _EULER + f" select {sel(_AC)} from ac")
def c9(spark, sf):
    return pick(C.solve_states(drive(spark, sf)), _AC)


def _rk4_sql(rate: str, y: str) -> str:
    """Value after one step from y, by nested stages."""
    g = lambda f, v: f"(({rate}) * ({v}) + {f} * (1 - ({v})))"
    k1 = g("f0", y)
    k2 = g("fm", f"{y} + 0.004::double * {k1}")
    k3 = g("fm", f"{y} + 0.004::double * {k2}")
    k4 = g("f1", f"{y} + 0.008::double * {k3}")
    return f"({y} + 0.008::double / 6 * ({k1} + 2 * {k2} + 2 * {k3} + {k4}))"


_RK4 = "sr as (select *, (f0 + f1) / 2 fm from st), " + scan_sql(
    f"{_rk4_sql('-0.1', '1')} - {_rk4_sql('-0.1', '0')}", _rk4_sql("-0.1", "0"),
    f"{_rk4_sql('0.05', '1')} - {_rk4_sql('0.05', '0')}", _rk4_sql("0.05", "0"), "sr",
)


@query("c10_states_rk4", _DRIVE + ", " + _RK4 + f" select {sel(_AC)} from ac")
def c10(spark, sf):
    return pick(C.solve_states(drive(spark, sf), "rk4"), _AC)


@query(
    "c11_extract_dynamics",
    _DRIVE + ", " + _EULER + ", " + _PHASE
    + " select session_id, channel_idx, sample_idx, round(a, 6) a, round(c, 6) c, round(cos(b), 5) + 0.0 cos_b, round(sin(b), 5) + 0.0 sin_b from ac join ph using (session_id, channel_idx, sample_idx)",
)
def c11(spark, sf):
    out = C.extract_dynamics(views.samples(spark, sf))
    return pick(out.withColumn("cos_b", F.cos("b")).withColumn("sin_b", F.sin("b")), _AC + " cos_b:5 sin_b:5")


@query(
    "c11_cropped_dynamics",
    _DRIVE.replace(S_SQL, CROPPED_SQL) + ", " + _EULER + ", " + _PHASE
    + f" select session_id, channel_idx, sample_idx + {CROP} sample_idx, round(a, 6) a, round(c, 6) c, round(cos(b), 5) + 0.0 cos_b, round(sin(b), 5) + 0.0 sin_b from ac join ph using (session_id, channel_idx, sample_idx)",
)
def c11_cropped(spark, sf):
    out = C.extract_dynamics(cropped(spark, sf))
    return pick(out.withColumn("cos_b", F.cos("b")).withColumn("sin_b", F.sin("b")), _AC + " cos_b:5 sin_b:5")


@query(
    "c12_reject_epochs",
    with_(S_SQL)
    + """select session_id, win, round(max(p), 6) max_p2p from (select session_id, channel_idx, sample_idx // 64 win, max(uv) - min(uv) p from s group by all having count(*) = 64)
     group by all having max(p) <= 450""",
)
def c12(spark, sf):
    epochs = assign_windows(views.samples(spark, sf), 64, 64)
    return pick(C.reject_epochs(epochs, ["session_id", "win"], 450.0), "session_id win max_p2p:6")


@query(
    "c13_bad_channels",
    with_(S_SQL)
    + """, v as (select session_id, channel_idx, var_pop(uv) variance from s group by all),
  m as (select *, quantile_cont(variance, 0.5) over (partition by session_id) med from v),
  d as (select *, quantile_cont(abs(variance - med), 0.5) over (partition by session_id) mad from m)
  select session_id, channel_idx, round(variance, 4) variance, round(0.6745 * (variance - med) / mad, 6) z from d where mad > 0 and abs(0.6745 * (variance - med) / mad) > 1.0""",
)
def c13(spark, sf):
    return pick(C.bad_channels(views.samples(spark, sf), 1.0), "session_id channel_idx variance:4 z:6")


@query(
    "c14_evoked_response",
    with_(S_SQL, M_SQL)
    + """, ep as (select s.session_id, s.channel_idx, sample_index onset, label, (sample_idx - sample_index)::int "offset", uv from s join m on s.session_id = m.session_id and sample_idx between sample_index - 25 and sample_index + 100),
  bl as (select *, uv - avg(uv) filter ("offset" between -25 and 0) over (partition by session_id, channel_idx, onset, label) v, count(*) over (partition by session_id, channel_idx, onset, label) held from ep)
  select label, channel_idx, "offset", round(avg(v), 5) + 0.0 uv, count(*) n from bl where held = 126 group by all""",
)
def c14(spark, sf):
    epochs = C.stimulus_epochs(views.samples(spark, sf), views.markers(spark, sf))
    return pick(C.evoked(epochs), "label channel_idx offset uv:5 n")


@query(
    "p9_session_zscore",
    with_(L_SQL)
    + f"select {_CH}, sample_idx, round((uv - avg(uv) over (partition by {_CH})) / nullif(stddev_pop(uv) over (partition by {_CH}), 0), 6) + 0.0 z from l",
)
def p9(spark, sf):
    return pick(C.scale_by_session(views.volume_samples(spark, sf)), "session_id channel_idx sample_idx z:6")
