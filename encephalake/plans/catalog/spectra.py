"""Spectra, band powers, coherence, classical features and response tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...dims import BANDS, CHANNEL_NAMES, FOCUS_BANDS, FOCUS_PAIRS
from ...operators import features as E
from ...operators import response as R
from ...operators import spectral as D
from ...operators import windows as W
from ...streaming.operators import feedback
from .. import views
from .base import (
    CROP, CROPPED_SQL, M_SQL, S_SQL, WIN_KEYS, bands_sql, encoded_sql, pick, query, sel, spectrum_sql, windows_sql, with_,
)
from .windows import MARKED_SQL, PARITY_SQL, SEGMENTS_SQL, parity_labels, phase_segments

WKEYS = ["session_id", "channel_idx", "win"]
_BANDS = " ".join(f"{b}:6" for b in BANDS)


def spans(spark, sf, w=250, hop=250):
    return D.spans_from_windows(views.samples(spark, sf), w, hop)


def window_psd(spark, sf, w=250, hop=250, taper="hann"):
    return D.welch(spans(spark, sf, w, hop), WKEYS, w, taper=taper, averaged=False)


_WHOLE_SEGS = """wh as (
  select t.session_id, t.channel_idx, q.seg, sample_idx - q.seg * {hop} j, {n} n, uv
  from s t join (select session_id, channel_idx, unnest(range((count(*) - {n}) // {hop} + 1)) seg from s group by 1, 2) q
    on t.session_id = q.session_id and t.channel_idx = q.channel_idx and sample_idx >= q.seg * {hop} and sample_idx < q.seg * {hop} + {n})"""
_WHOLE = with_(S_SQL, _WHOLE_SEGS.format(hop=125, n=250), spectrum_sql("sp", "wh", "session_id, channel_idx, seg"))
_MEAN_PSD = "ps as (select session_id, channel_idx, k, freq, n, avg(psd) psd from sp group by all)"


def whole_psd(spark, sf, **kw):
    keys = ["session_id", "channel_idx"]
    return D.welch(D.spans_whole(views.samples(spark, sf)), keys, 250, **kw)


@query("d1_welch_spectrum", _WHOLE + "select session_id, channel_idx, k::int k, freq, round(avg(psd), 5) psd from sp group by session_id, channel_idx, sp.k, freq")
def d1(spark, sf):
    return pick(whole_psd(spark, sf), "session_id channel_idx k freq psd:5")


_WSPEC = with_(S_SQL, windows_sql("wn"), spectrum_sql("sp", "wn", WIN_KEYS))


@query("d2_band_powers", _WSPEC + ", " + bands_sql("bp", "sp", WIN_KEYS) + f" select {sel('session_id channel_idx win ' + _BANDS)} from bp")
def d2(spark, sf):
    return pick(D.band_powers(window_psd(spark, sf), WKEYS), "session_id channel_idx win " + _BANDS)


def coherence_sql(name: str, spectrum: str, keys: str, lo: float = 8, hi: float = 13) -> str:
    using = keys.replace(" ", "")
    return f"""{name} as (
  select {keys}, ch_i, ch_j, avg((re * re + im * im) / (sxx * syy)) coh from (
    select {', '.join('a.' + k for k in using.split(','))}, a.channel_idx ch_i, b.channel_idx ch_j, a.k,
           sum(a.re * b.re + a.im * b.im) re, sum(a.re * b.im - a.im * b.re) im,
           sum(a.re * a.re + a.im * a.im) sxx, sum(b.re * b.re + b.im * b.im) syy
    from {spectrum} a join {spectrum} b on {' and '.join(f'a.{k} = b.{k}' for k in using.split(','))} and a.seg = b.seg and a.k = b.k and a.channel_idx < b.channel_idx
    where a.freq >= {lo} and a.freq < {hi} group by all) group by all)"""


@query(
    "d3_pairwise_coherence",
    _WHOLE + ", " + coherence_sql("co", "sp", "session_id") + " select session_id, ch_i, ch_j, round(coh, 6) coherence from co",
)
def d3(spark, sf):
    out = D.coherence(D.spans_whole(views.samples(spark, sf)), ["session_id"])
    return pick(out, "session_id ch_i ch_j coherence:6")


_ABC = "session_id channel_idx win a:6 b:6 c:6"


@query("d4_encode_per_channel", with_(S_SQL, encoded_sql(250)) + f"select {sel(_ABC)} from pns")
def d4(spark, sf):
    return pick(D.encode_bands(D.band_powers(window_psd(spark, sf), WKEYS)), _ABC)


_WHOLE_BANDS = _WHOLE + ", " + _MEAN_PSD + ", " + bands_sql("bp", "ps", "session_id, channel_idx")


@query(
    "d5_encode_global",
    _WHOLE_BANDS + ", " + coherence_sql("co", "sp", "session_id")
    + " select session_id, channel_idx, round(beta + gamma, 6) a, round(g * 2 * pi(), 6) b, round(delta + theta, 6) c from bp join (select session_id, avg(coh) g from co group by 1) using (session_id)",
)
def d5(spark, sf):
    out = D.encode_multichannel(D.spans_whole(views.samples(spark, sf)), ["session_id"])
    return pick(out, "session_id channel_idx a:6 b:6 c:6")


#: Samples of a coherence segment in sliding windows: four half-overlapping ones in two seconds.
SHORT = 100


def short_coherence_sql(name: str, windows: str) -> str:
    """Coherence of the channel pairs of each window from its short segments."""
    return ",\n".join(
        [
            f"""{name}_g as (select session_id, win, channel_idx, seg, uv, j - seg * {SHORT // 2} j, {SHORT} n
  from {windows}, (select unnest(range((250 - {SHORT}) // {SHORT // 2} + 1)) seg) where j >= seg * {SHORT // 2} and j < seg * {SHORT // 2} + {SHORT})""",
            spectrum_sql(f"{name}_s", f"{name}_g", "session_id, win, channel_idx, seg"),
            coherence_sql(name, f"{name}_s", "session_id, win"),
        ]
    )


@query(
    "d6_encode_sliding",
    with_(S_SQL, encoded_sql(62), short_coherence_sql("co", "wn"))
    + """select session_id, channel_idx, win, round((win * 62 + 125.0::double) / 125, 6) center_sec, round(a, 6) a, round(2 * pi() * g, 6) b, round(c, 6) c
  from pns join (select session_id, win, avg(coh) g from co group by all) using (session_id, win)""",
)
def d6(spark, sf):
    return pick(D.encode_sliding(views.samples(spark, sf), coherence_nperseg=SHORT), "session_id channel_idx win center_sec:6 a:6 b:6 c:6")


_ALPHA = "alpha_power:5 total_power:5 alpha_ratio:6 peak_freq peak_power:5"
_ALPHA_AGG = "avg(psd) filter (freq between 8 and 13) alpha_power, avg(psd) total_power, avg(psd) filter (freq between 8 and 13) / avg(psd) alpha_ratio, arg_max(freq, psd) filter (freq between 8 and 13) peak_freq, max(psd) filter (freq between 8 and 13) peak_power"


@query(
    "d7_alpha_summary",
    _WHOLE + ", " + _MEAN_PSD + f", z as (select session_id, channel_idx, {_ALPHA_AGG} from ps group by all) select {sel('session_id channel_idx ' + _ALPHA)} from z",
)
def d7(spark, sf):
    return pick(D.alpha_summary(whole_psd(spark, sf), ["session_id", "channel_idx"]), "session_id channel_idx " + _ALPHA)


@query(
    "d8_band_power_map",
    with_(S_SQL, _WHOLE_SEGS.format(hop=250, n=250), spectrum_sql("sp", "wh", "session_id, channel_idx, seg", "hamming"))
    + "select session_id, channel_idx, round(avg(psd), 5) band_power from sp where freq between 8 and 12 group by all",
)
def d8(spark, sf):
    psd = whole_psd(spark, sf, overlap=0.0, taper="hamming")
    return pick(D.band_mean(psd, ["session_id", "channel_idx"], 8.0, 12.0), "session_id channel_idx band_power:5")


@query(
    "d8_cropped_band_map",
    with_(CROPPED_SQL, _WHOLE_SEGS.format(hop=250, n=250), spectrum_sql("sp", "wh", "session_id, channel_idx, seg", "hamming"))
    + "select session_id, channel_idx, round(avg(psd), 5) band_power from sp where freq between 8 and 12 group by all",
)
def d8_cropped(spark, sf):
    keys = ["session_id", "channel_idx"]
    spans = D.spans_whole(views.samples(spark, sf).where(F.col("sample_idx") >= CROP))
    return pick(D.band_mean(D.welch(spans, keys, 250, overlap=0.0, taper="hamming"), keys, 8.0, 12.0), "session_id channel_idx band_power:5")


@query(
    "d9_named_channel_spectra",
    _WHOLE + "select session_id, channel_idx, k::int k, round(avg(psd), 5) psd from sp where channel_idx in (7, 13, 14) group by session_id, channel_idx, sp.k",
)
def d9(spark, sf):
    named = views.samples(spark, sf).where(F.col("channel").isin("Oz", "O2", "O1", "T7"))
    psd = D.welch(D.spans_whole(named), ["session_id", "channel_idx"], 250)
    return pick(psd, "session_id channel_idx k psd:5")


_PAIRS = ", ".join(f"({CHANNEL_NAMES.index(a)}, {CHANNEL_NAMES.index(b)}, '{a}-{b}')" for a, b in FOCUS_PAIRS)
_FOCUS = (
    _WHOLE
    + ", pr(x, y, pair) as (values " + _PAIRS + "), "
    + "fb(band, lo, hi) as (values " + ", ".join(f"('{n}', {lo}, {hi})" for n, (lo, hi) in FOCUS_BANDS.items()) + "), "
    + """fc as (select session_id, pair, band, avg((re * re + im * im) / (sxx * syy)) coherence from (
    select a.session_id, pair, band, a.k, sum(a.re * b.re + a.im * b.im) re, sum(a.re * b.im - a.im * b.re) im,
      sum(a.re * a.re + a.im * a.im) sxx, sum(b.re * b.re + b.im * b.im) syy
    from pr join sp a on a.channel_idx = least(x, y) join sp b on b.channel_idx = greatest(x, y) and a.session_id = b.session_id and a.seg = b.seg and a.k = b.k
      join fb on a.freq >= lo and a.freq < hi group by all) group by all)
  select session_id, pair, band, round(coherence, 6) coherence from fc"""
)


@query("d10_focus_coherence", _FOCUS)
def d10(spark, sf):
    out = D.focus_coherence(D.spans_whole(views.samples(spark, sf)), ["session_id"], FOCUS_BANDS, CHANNEL_NAMES)
    return pick(out, "session_id pair band coherence:6")


@query(
    "d10_focus_band_powers",
    _WSPEC + ", " + bands_sql("bp", "sp", WIN_KEYS, FOCUS_BANDS) + " select session_id, channel_idx, win, round(gamma, 6) gamma, round(alpha, 6) alpha from bp",
)
def d10_bands(spark, sf):
    out = D.band_powers(window_psd(spark, sf), WKEYS, FOCUS_BANDS)
    return pick(out, "session_id channel_idx win gamma:6 alpha:6")


# ---------------------------------------------------------------- classical features

_RATIOS = " ".join(f"{a}_{b}_ratio:4" for a, b in E.RATIO_PAIRS)
_RATIO_SQL = ", ".join(f"round({a} / ({b} + 1e-10), 4) + 0.0 {a}_{b}_ratio" for a, b in E.RATIO_PAIRS)


@query("e1_band_ratios", _WSPEC + ", " + bands_sql("bp", "sp", WIN_KEYS) + f" select session_id, channel_idx, win, {_RATIO_SQL} from bp")
def e1(spark, sf):
    return pick(E.band_ratios(D.band_powers(window_psd(spark, sf), WKEYS)), "session_id channel_idx win " + _RATIOS)


SHAPE_SQL = """df as (select session_id, channel_idx, win, j, uv x,
    lead(uv) over w - uv d1, lead(uv, 2) over w - 2 * lead(uv) over w + uv d2, (sign(lead(uv) over w) <> sign(uv))::int zc, avg(uv) over (partition by session_id, channel_idx, win) mu
  from wn window w as (partition by session_id, channel_idx, win order by j)),
sh as (select session_id, channel_idx, win, avg(x) mean, stddev_pop(x) std,
    avg(pow(x - mu, 3)) / pow(stddev_pop(x), 3) skew, avg(pow(x - mu, 4)) / pow(stddev_pop(x), 4) - 3 kurtosis,
    var_pop(x) hjorth_activity, sqrt(var_pop(d1) / (var_pop(x) + 1e-10)) hjorth_mobility,
    sqrt(var_pop(d2) / (var_pop(d1) + 1e-10)) / (sqrt(var_pop(d1) / (var_pop(x) + 1e-10)) + 1e-10) hjorth_complexity,
    sum(abs(d1)) line_length, sum(zc)::bigint zero_crossings from df group by all)"""
_SHAPE_BASE = with_(S_SQL, windows_sql("wn"), SHAPE_SQL)


def _shape(name, spec):
    @query(name, _SHAPE_BASE + f"select {sel('session_id channel_idx win ' + spec)} from sh")
    def run(spark, sf):
        return pick(E.waveform_features(spans_full(spark, sf), WKEYS), "session_id channel_idx win " + spec)


def spans_full(spark, sf, w=250, hop=250):
    """Samples of complete windows only."""
    from pyspark.sql import Window

    full = F.count(F.lit(1)).over(Window.partitionBy(*WKEYS))
    return spans(spark, sf, w, hop).withColumn("_c", full).where(F.col("_c") == w).drop("_c")


_shape("e2_moments", "mean:6 std:6 skew:6 kurtosis:6")
_shape("e3_hjorth", "hjorth_activity:4 hjorth_mobility:6 hjorth_complexity:6")
_shape("e4_line_length", "line_length:4")
_shape("e5_zero_crossings", "zero_crossings")

_ENTROPY = """en as (select session_id, channel_idx, win, -sum(p * log2(p + 1e-10)) / log2(count(*)) spectral_entropy from (
    select *, psd / (sum(psd) over (partition by session_id, channel_idx, win) + 1e-10) p from sp) group by all)"""


@query("e6_spectral_entropy", _WSPEC + ", " + _ENTROPY + " select session_id, channel_idx, win, round(spectral_entropy, 6) spectral_entropy from en")
def e6(spark, sf):
    return pick(E.spectral_entropy(window_psd(spark, sf), WKEYS), "session_id channel_idx win spectral_entropy:6")


_E7_LIST = ", ".join(
    f"('{n}', {expr})"
    for n, expr in [(f"{b}_power", b) for b in BANDS]
    + [(f"{a}_{b}_ratio", f"{a} / ({b} + 1e-10)") for a, b in E.RATIO_PAIRS]
    + [(n, n) for n in E.SHAPE]
    + [("spectral_entropy", "spectral_entropy")]
)
_NAMES = "[" + ",".join(f"'{n}'" for n in CHANNEL_NAMES) + "]"
_E7 = (
    _WSPEC + ", " + bands_sql("bp", "sp", WIN_KEYS) + ", " + SHAPE_SQL + ", " + _ENTROPY
    + f""", al as (select * from bp join sh using ({WIN_KEYS}) join en using ({WIN_KEYS})), {short_coherence_sql("co", "wn")}
  select session_id, win, {_NAMES}[channel_idx + 1] || '_' || u.f as name, round(u.v, 4) + 0.0 as value
  from al, lateral (values {_E7_LIST}) u(f, v)
  union all
  select session_id, win, 'coh_' || {_NAMES}[ch_i + 1] || '_' || {_NAMES}[ch_j + 1], round(coh, 4) + 0.0 from co"""
)


@query("e7_feature_vector", _E7)
def e7(spark, sf):
    rows = E.window_features(views.samples(spark, sf), 250, 250, CHANNEL_NAMES, coherence_nperseg=SHORT)
    return pick(rows, "session_id win name value:4")


# ---------------------------------------------------------------- response tests

_SEG_KEYS = "session_id, channel, channel_idx, seg, label"
_SEG_BANDS = with_(S_SQL, M_SQL, PARITY_SQL, SEGMENTS_SQL, spectrum_sql("sp", "seg", _SEG_KEYS), bands_sql("bp", "sp", _SEG_KEYS))
_VERDICT = """pc as (select session_id, channel, coalesce(avg(v) filter (label = 0), 0) mean_0, coalesce(avg(v) filter (label = 1), 0) mean_1 from src group by all),
  rt as (select *, mean_1 / (mean_0 + 1e-10) ratio from pc)
  select session_id, channel, round(mean_0, 6) mean_0, round(mean_1, 6) mean_1, round(ratio, 5) ratio,
    round(avg(ratio) over (partition by session_id), 5) mean_ratio, avg(ratio) over (partition by session_id) > {thr} passed from rt"""
_RESP = "session_id channel mean_0:6 mean_1:6 ratio:5 mean_ratio:5 passed"


@query("j1_alpha_response", _SEG_BANDS + ", src as (select *, alpha v from bp where channel in ('O1','O2','P3','P4')), " + _VERDICT.format(thr=1.2))
def j1(spark, sf):
    return pick(R.alpha_response(views.samples(spark, sf), parity_labels(spark, sf)), _RESP)


@query("j2_slowing_response", _SEG_BANDS + ", src as (select *, delta + theta v from bp), " + _VERDICT.format(thr=1.3))
def j2(spark, sf):
    return pick(R.slowing_response(views.samples(spark, sf), parity_labels(spark, sf)), _RESP)


@query(
    "j3_alpha_blocking",
    with_(S_SQL, M_SQL, MARKED_SQL)
    + """, cut as (select s.session_id, channel, segment, sample_idx - start_idx j, end_idx - start_idx n, uv from s join ms on ms.session_id = s.session_id and sample_idx >= start_idx and sample_idx < end_idx where channel in ('O1','O2')), """
    + spectrum_sql("sp", "cut", "session_id, channel, segment")
    + """, al as (select session_id, channel, segment, avg(psd) a from sp where freq between 8 and 13 group by all),
   ra as (select session_id, channel, avg(a) filter (contains(segment, 'open')) open_power, avg(a) filter (contains(segment, 'closed')) closed_power from al group by all)
   select session_id, channel, round(open_power, 5) open_power, round(closed_power, 5) closed_power, round(closed_power / open_power, 5) ratio,
     bool_or(closed_power / open_power > 2.0) over (partition by session_id) passed from ra where open_power is not null and closed_power is not null""",
)
def j3(spark, sf):
    picked = views.samples(spark, sf).where(F.col("channel").isin("O1", "O2"))
    cut = W.cut_segments(picked, phase_segments(spark, sf)).withColumnRenamed("seg_len", "span_len")
    return pick(R.alpha_blocking(cut), "session_id channel open_power:5 closed_power:5 ratio:5 passed")


# ---------------------------------------------------------------- further items


@query("p1_spectrum_db", _WSPEC + "select session_id, channel_idx, win, k::int k, round(10 * log10(psd), 5) + 0.0 db from sp")
def p1(spark, sf):
    return pick(D.decibels(window_psd(spark, sf)), "session_id channel_idx win k db:5")


_ONE_SEC = with_(S_SQL, windows_sql("wn", w=125, hop=125), spectrum_sql("sp", "wn", WIN_KEYS), bands_sql("bp", "sp", WIN_KEYS))


@query(
    "p5_feedback_amplitude",
    _ONE_SEC
    + """select session_id, channel_idx, win, round(case when channel_idx >= 8 then null else greatest(0.1, least(1.0, 1 - least((alpha - b) / (2 * b), 1.0))) end, 6) amplitude
     from (select *, avg(alpha) over (partition by session_id, channel_idx) b from bp)""",
)
def p5(spark, sf):
    """Baseline: a channel's mean alpha; the second board's channels are the control block."""
    psd = D.welch(spans(spark, sf, 125, 125), WKEYS, 125, averaged=False)
    powers = D.band_powers(psd, WKEYS, nperseg=125)
    base = powers.groupBy("session_id", "channel_idx").agg(F.avg("alpha").alias("base_alpha"))
    base = base.withColumn("is_control", F.col("channel_idx") >= 8)
    out = feedback(powers, base, ["session_id", "channel_idx"])
    return pick(out.withColumn("amplitude", F.nanvl("amplitude", F.lit(None).cast("double"))), "session_id channel_idx win amplitude:6")


@query(
    "p6_compare_recordings",
    _WHOLE + ", " + _MEAN_PSD
    + """, j as (select a.channel_idx, a.freq, a.psd a, b.psd b, abs(10 * log10(a.psd) - 10 * log10(b.psd)) d from ps a join ps b on a.session_id = 'S0' and b.session_id = 'S1' and a.channel_idx = b.channel_idx and a.k = b.k),
   z as (select channel_idx, max(d) max_db, avg((d <= 3)::int) share_within, abs(arg_max(freq, a) filter (freq between 8 and 13) - arg_max(freq, b) filter (freq between 8 and 13)) peak_shift_hz, abs(sqrt(sum(b)) / sqrt(sum(a)) - 1) rms_change from j group by all)
   select channel_idx, round(max_db, 5) max_db, round(share_within, 6) share_within, peak_shift_hz, round(rms_change, 6) rms_change, max_db <= 3 and peak_shift_hz <= 0.5 and rms_change <= 0.01 agrees from z""",
)
def p6(spark, sf):
    psd = whole_psd(spark, sf)
    side = lambda s: psd.where(F.col("session_id") == s).drop("session_id")
    out = D.compare_recordings(side("S0"), side("S1"), ["channel_idx"], tol_db=3.0)
    return pick(out, "channel_idx max_db:5 share_within:6 peak_shift_hz rms_change:6 agrees")


@query(
    "p8_encode_with_reference",
    _WHOLE_BANDS + ", " + coherence_sql("co", "sp", "session_id")
    + " select session_id, channel_idx, round(beta + gamma, 6) a, round(g * 2 * pi(), 6) b, round(delta + theta, 6) c from bp join (select session_id, avg(coh) g from co where ch_i = 10 or ch_j = 10 group by 1) using (session_id)",
)
def p8(spark, sf):
    out = D.encode_multichannel(D.spans_whole(views.samples(spark, sf)), ["session_id"], reference=CHANNEL_NAMES.index("Pz"))
    return pick(out, "session_id channel_idx a:6 b:6 c:6")


@query(
    "p9_amplitude_flags",
    with_(S_SQL, windows_sql("wn")) + "select session_id, channel_idx, win, round(max(abs(uv)), 6) peak_uv, max(abs(uv)) > 150 flagged from wn group by all",
)
def p9(spark, sf):
    return pick(E.amplitude_flags(spans_full(spark, sf), WKEYS), "session_id channel_idx win peak_uv:6 flagged")


def _scale_sql(w: int) -> str:
    return windows_sql(f"w{w}", w=w, hop=32) + f""", f{w} as (select session_id, channel_idx, win, stddev_pop(uv) std_{w}, sum(abs(d)) line_length_{w}
      from (select *, lead(uv) over (partition by session_id, channel_idx, win order by j) - uv d from w{w}) group by all)"""


_SCALES = "session_id channel_idx win std_64:6 line_length_64:4 std_128:6 line_length_128:4 std_256:6 line_length_256:4"


@query(
    "p10_multiscale_features",
    with_(S_SQL, _scale_sql(64), _scale_sql(128), _scale_sql(256))
    + """, z as (select f64.*, std_128, line_length_128, std_256, line_length_256 from f64 join f128 on f64.session_id = f128.session_id and f64.channel_idx = f128.channel_idx and f128.win = f64.win - 1
        join f256 on f64.session_id = f256.session_id and f64.channel_idx = f256.channel_idx and f256.win = f64.win - 3) """
    + f"select {sel(_SCALES)} from z",
)
def p10(spark, sf):
    return pick(E.multiscale(views.samples(spark, sf), [64, 128, 256], 32), _SCALES)
