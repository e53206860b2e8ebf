"""Splits, metrics, comparisons and template similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...dims import SUBSETS
from ...functions.expr import channel_name
from ...functions.quantiles import exact_quantiles
from ...functions.layout import spread_join
from ...operators import evaluate as K
from ...operators import features as E
from ...operators import fidelity as L
from ...operators import windows as W
from ...operators.project import channel_subset
from ...session import materialise
from ...operators.spectral import encode_sliding, spans_from_windows
from .. import views
from .base import K_SQL, M_SQL, S_SQL, STATES_SQL, encoded_sql, pick, query, sel, windows_sql, with_
from .windows import intervals

_PRED = "kp as (select *, (score > (select quantile_cont(score, 0.5) from k))::int prediction from k)"
_KP = with_(K_SQL, _PRED)


def predicted(spark, sf):
    """Scores with a prediction: above the exact overall median."""
    k = views.scores(spark, sf).withColumn("_one", F.lit(0))
    median = exact_quantiles(k, ["_one"], "score", {"_med": 0.5})
    rows = spread_join(k, median, ["_one"], F.xxhash64("doc_id"))
    return rows.withColumn("prediction", (F.col("score") > F.col("_med")).cast("int")).drop("_one", "_med")


@query(
    "k1_valid_segments",
    with_(K_SQL)
    + ", g as (select lang, source, doc_id, case when toxic = 1 then -1 else truth end as label from k) select lang, source, doc_id, label from g where label >= 0 qualify count(*) over (partition by lang, source) >= 10",
)
def k1(spark, sf):
    rows = views.scores(spark, sf).select(
        "lang", "source", "doc_id", F.when(F.col("toxic") == 1, -1).otherwise(F.col("truth")).alias("label")
    )
    return K.valid_segments(rows, ["lang", "source"]).select("lang", "source", "doc_id", "label")


@query(
    "k2_stratified_split",
    with_(K_SQL)
    + """, o as (select *, ('0x' || substr(md5(doc_id || ':42'), 1, 15))::bigint h from k)
  select doc_id, truth, row_number() over (partition by truth order by h, doc_id) - 1 < round(0.3::double * count(*) over (partition by truth)) is_test from o""",
)
def k2(spark, sf):
    return K.stratified_split(views.scores(spark, sf), "truth", ["doc_id"]).select("doc_id", "truth", "is_test")


@query(
    "k2_ordered_split",
    with_(K_SQL)
    + "select lang, doc_id, truth, row_number() over (partition by lang order by doc_id) - 1 < floor(round(0.7 * count(*) over (partition by lang), 9)) is_train from k",
)
def k2_ordered(spark, sf):
    out = K.ordered_split(views.scores(spark, sf), ["lang"], F.expr("doc_id div 1024"), [F.col("doc_id")])
    return out.select("lang", "doc_id", "truth", "is_train")


def labelled_windows(spark, sf):
    """Window features with the parity of the state as the class."""
    spans = spans_from_windows(views.samples(spark, sf), 250, 62)
    keys = ["session_id", "channel_idx", "win"]
    full = W.sliding(views.samples(spark, sf), 250, 62, [F.avg("uv").alias("_m")])
    states = W.assign_states(full, intervals(spark, sf)).select(*keys, (F.right("label", F.lit(1)).cast("int") % 2).alias("label"))
    return E.channel_features(spans, keys, averaged=False).join(states, keys)


def split_windows(spark, sf):
    return materialise(K.stratified_split(labelled_windows(spark, sf), "label", ["session_id", "channel_idx", "win"]), "windows")


@query("k3_boosted_trees")
def k3(spark, sf):
    rows = split_windows(spark, sf)
    model = K.train_boosted_trees(rows.where(~F.col("is_test")), E.feature_names())
    out = K.predict(model, rows.where("is_test")).withColumn("_all", F.lit(0))
    return K.classification_metrics(out, ["_all"], "label").join(K.auc_table(out, ["_all"], "label"), "_all").drop("_all")


@query(
    "k3_trees_fit_their_rows",
    with_(S_SQL, M_SQL, STATES_SQL, windows_sql("wn", hop=62))
    + """, lw as (select distinct wn.session_id, channel_idx, win, right(label, 1)::int % 2 as label from wn join iv on wn.session_id = iv.session_id and (win * 62 + 125.0::double) / 125 >= onset_sec and (win * 62 + 125.0::double) / 125 < end_sec),
  o as (select *, ('0x' || substr(md5(session_id || ':' || channel_idx || ':' || win || ':42'), 1, 15))::bigint h from lw),
  t as (select *, row_number() over (partition by label order by h, session_id, channel_idx, win) - 1 < round(0.3::double * count(*) over (partition by label)) is_test from o)
  select is_test, label, count(*) n, case when is_test then null else true end fitted from t group by all""",
)
def k3_fit(spark, sf):
    """Rows of each class on either side of the split; the trees must separate the rows they were trained on."""
    rows = split_windows(spark, sf)
    model = K.train_boosted_trees(rows.where(~F.col("is_test")), E.feature_names(), trees=10, depth=5)
    fit = K.auc_table(K.predict(model, rows.where(~F.col("is_test"))).withColumn("_all", F.lit(0)), ["_all"], "label")
    counts = rows.groupBy("is_test", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    out = counts.join(fit.select("_all", (F.col("auc") > 0.8).alias("_good")), "_all")
    return out.select("is_test", "label", "n", F.when(~F.col("is_test"), F.col("_good")).alias("fitted"))


_METRICS = "n_samples accuracy:6 precision:6 recall:6 f1:6"


def metrics_sql(source: str, scope: str) -> str:
    s = scope + ", " if scope else ""
    cls = f"""(select {s}cls, sum(sup) support, sum(prd) predicted, sum(hit) hit from (
      select {s}truth cls, 1 sup, 0 prd, (truth = prediction)::int hit from {source} union all select {s}prediction, 0, 1, 0 from {source}) group by all)"""
    return f"""select {s}sum(support)::bigint n_samples, sum(hit) / sum(support) accuracy,
      sum(coalesce(hit / nullif(predicted, 0), 0) * support) / sum(support) as "precision",
      sum(coalesce(hit / nullif(support, 0), 0) * support) / sum(support) recall,
      sum(coalesce(2.0 * hit / nullif(support + predicted, 0), 0) * support) / sum(support) f1 from {cls} group by all"""


@query("k4_classification_metrics", _KP + f", z as ({metrics_sql('kp', 'lang')}) select lang, {sel(_METRICS)} from z")
def k4(spark, sf):
    return pick(K.classification_metrics(predicted(spark, sf), ["lang"]), "lang " + _METRICS)


def auc_sql(source: str, scope: str, truth: str = "truth", score: str = "score") -> str:
    part = f"partition by {scope}" if scope else ""
    both = f"partition by {scope}, {score}" if scope else f"partition by {score}"
    s = scope + ", " if scope else ""
    return f"""select {s}n_pos, n_neg, coalesce((rs - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 0.5) auc from (
      select {s}sum({truth})::bigint n_pos, sum(1 - {truth})::bigint n_neg, sum(r) filter ({truth} = 1) rs from (
        select *, rank() over ({part} order by {score}) + (count(*) over ({both}) - 1) / 2.0 r from {source}) group by all)"""


@query("k5_auc", with_(K_SQL) + f", z as ({auc_sql('k', '')}) select n_pos, n_neg, round(auc, 6) auc from z")
def k5(spark, sf):
    return pick(K.auc_table(views.scores(spark, sf)), "n_pos n_neg auc:6")


@query("k5_auc_by_language", with_(K_SQL) + f", z as ({auc_sql('k', 'lang')}) select lang, n_pos, n_neg, round(auc, 6) auc from z")
def k5_lang(spark, sf):
    return pick(K.auc_table(views.scores(spark, sf), ["lang"]), "lang n_pos n_neg auc:6")


@query(
    "k5_multiclass_auc",
    with_(
        K_SQL,
        "m3 as (select truth + toxic t3, score from k)",
        "lg as (select c, (t3 = c)::int hit, case c when 0 then -score when 1 then score else score * score end v from m3, (values (0), (1), (2)) q(c))",
        f"z as ({auc_sql('lg', 'c', 'hit', 'v')})",
    )
    + "select round(sum(auc * n_pos) / sum(n_pos), 6) auc from z",
)
def k5_multi(spark, sf):
    rows = views.scores(spark, sf).select(
        (F.col("truth") + F.col("toxic")).alias("truth"), (-F.col("score")).alias("s0"), F.col("score").alias("s1"),
        (F.col("score") * F.col("score")).alias("s2"),
    )
    return pick(K.multiclass_auc(rows, [0, 1, 2], ["s0", "s1", "s2"]), "auc:6")


@query("k5_hard_label_auc", _KP + f", z as ({metrics_sql('kp', 'lang')}) select lang, round((\"precision\" + recall) / 2, 6) auc from z")
def k5_hard(spark, sf):
    return pick(K.hard_label_auc(K.classification_metrics(predicted(spark, sf), ["lang"])), "lang auc:6")


def results(spark, sf):
    """Two scored methods per source: text length and the absence of toxicity."""
    base = predicted(spark, sf)
    alt = base.withColumn("score", 1.0 - F.col("toxic")).withColumn("prediction", 1 - F.col("toxic"))
    both = base.withColumn("method", F.lit("template")).unionByName(alt.withColumn("method", F.lit("classical")))
    scope = ["source", "method"]
    n = F.when(F.col("method") == "template", 48).otherwise(520)
    return (
        K.classification_metrics(both, scope).select(*scope, "accuracy", "f1")
        .join(K.auc_table(both, scope).select(*scope, "auc"), scope)
        .withColumn("n_features", n)
    )


_BOTH = """bo as (select source, 'template' as method, truth, score, prediction from kp
   union all select source, 'classical', truth, 1.0 - toxic, 1 - toxic from kp)"""
_K6 = "source delta_accuracy:6 delta_auc:6 delta_f1:6 feature_ratio:6 interpretation bottleneck_confirmed"


@query(
    "k6_method_comparison",
    with_(K_SQL, _PRED, _BOTH, f"me as ({metrics_sql('bo', 'source, method')})", f"au as ({auc_sql('bo', 'source, method')})")
    + """, r as (select * from me join au using (source, method)),
  p as (select q.source, q.accuracy - c.accuracy delta_accuracy, q.auc - c.auc delta_auc, q.f1 - c.f1 delta_f1, 520 / 48.0::double feature_ratio, q.auc qa, c.auc ca
        from r q join r c on q.source = c.source and q.method = 'template' and c.method = 'classical'),
  z as (select *, case when qa > 0.8 and qa > ca then 'template_good_and_ahead' when qa > 0.8 then 'template_good_but_behind' when qa >= 0.65 then 'template_fair'
        when qa < 0.65 and ca < 0.65 then 'both_weak' else 'template_weak' end interpretation, ca > 0.8 and qa < 0.65 bottleneck_confirmed from p) """
    + f"select {sel(_K6)} from z",
)
def k6(spark, sf):
    return pick(K.compare_methods(results(spark, sf), ["source"]), _K6)


@query(
    "k7_channel_scaling",
    with_(
        K_SQL,
        "x as (select lang, 4 * (1 << (doc_id % 3)::int) n_channels, truth, score, 1.0 - toxic alt from k)",
        f"q as ({auc_sql('x', 'lang, n_channels')})",
        f"c as ({auc_sql('x', 'lang, n_channels', 'truth', 'alt')})",
    )
    + """select lang, min(n_channels) filter (q.auc >= c.auc) crossover, round(case when count(*) >= 2 then regr_slope(q.auc, ln(n_channels)) else 0 end, 6) slope_q,
      round(case when count(*) >= 2 then regr_slope(c.auc, ln(n_channels)) else 0 end, 6) slope_c, round(arg_max(q.auc - c.auc, n_channels), 6) + 0.0 advantage from q join c using (lang, n_channels) group by all""",
)
def k7(spark, sf):
    rows = views.scores(spark, sf).withColumn("n_channels", F.expr("4 * shiftleft(1, cast(doc_id % 3 as int))"))
    scope = ["lang", "n_channels"]
    q = K.auc_table(rows, scope).select(*scope, F.col("auc").alias("auc_q"))
    c = K.auc_table(rows.withColumn("alt", 1.0 - F.col("toxic")), scope, "truth", "alt").select(*scope, F.col("auc").alias("auc_c"))
    out = K.channel_scaling(q.join(c, scope), ["lang"])
    return pick(out, "lang crossover slope_q:6 slope_c:6 advantage:6")


# ---------------------------------------------------------------- template similarity

SEG = ["session_id", "win"]


def encodings(spark, sf):
    pn = encode_sliding(views.samples(spark, sf), mode="per_channel")
    return pn.withColumn("channel", channel_name(F.col("channel_idx")))


_AMPS = "session_id win channel_idx " + " ".join(f"{p}_{k}:6" for k in L.AMPLITUDES for p in ("re", "im"))
_ENC_SQL = """en as (select *, b * (a - c) f from pns),
  am as (select session_id, win, channel_idx,
    sqrt((1-a)*(1-c)) * cos(-(b+f)/2) re_00, sqrt((1-a)*(1-c)) * sin(-(b+f)/2) im_00, sqrt(a*(1-c)) * cos((b+f)/2) re_10, sqrt(a*(1-c)) * sin((b+f)/2) im_10,
    sqrt((1-a)*c) * cos((f-b)/2) re_01, sqrt((1-a)*c) * sin((f-b)/2) im_01, sqrt(a*c) * cos((b-f)/2) re_11, sqrt(a*c) * sin((b-f)/2) im_11 from en)"""
_PNS = with_(S_SQL, encoded_sql(62), _ENC_SQL)


@query("l1_encode_states", _PNS + f"select {sel(_AMPS)} from am")
def l1(spark, sf):
    return pick(L.encode_states(encodings(spark, sf)), _AMPS)


@query(
    "l2_ring_order",
    with_(S_SQL) + "select session_id, channel, (list_position(['Fp1','F7','F3','Fz','C3','P3','O1','Oz','Pz','O2','P4','C4','Cz','F4','F8','Fp2'], channel) - 1)::int ord, count(*) n from s group by all",
)
def l2(spark, sf):
    return L.ring_order(views.samples(spark, sf)).groupBy("session_id", "channel", "ord").agg(F.count(F.lit(1)).alias("n"))


_DOT = {
    "re": " + ".join(f"x.re_{k} * y.re_{k} + x.im_{k} * y.im_{k}" for k in L.AMPLITUDES),
    "im": " + ".join(f"x.re_{k} * y.im_{k} - x.im_{k} * y.re_{k}" for k in L.AMPLITUDES),
}


@query(
    "l3_pair_fidelity",
    _PNS
    + f""", d as (select x.session_id, x.win w1, y.win w2, x.channel_idx, {_DOT['re']} re, {_DOT['im']} im from am x join am y on x.session_id = y.session_id and y.win = x.win + 1 and x.channel_idx = y.channel_idx),
  z as (select session_id, w1, w2, list_reduce(list({{'re': re, 'im': im}} order by channel_idx), lambda p, q: {{'re': p.re * q.re - p.im * q.im, 'im': p.re * q.im + p.im * q.re}}) g from d group by all)
  select session_id session_id_1, session_id session_id_2, w1 win_1, w2 win_2, round(g.re * g.re + g.im * g.im, 6) fidelity from z""",
)
def l3(spark, sf):
    """Every window against the next one of its session."""
    encoded = L.encode_states(encodings(spark, sf))
    here = encoded.select(*SEG).distinct()
    pairs = here.select(
        F.col("session_id").alias("session_id_1"), F.col("session_id").alias("session_id_2"),
        F.col("win").alias("win_1"), (F.col("win") + 1).alias("win_2"),
    )
    return pick(L.pair_kernels(encoded, pairs, SEG), "session_id_1 session_id_2 win_1 win_2 fidelity:6")


def split_states(spark, sf, subset="4"):
    """Segment states with class and the in-order train flag, written once for templates and scoring."""
    pn = channel_subset(encodings(spark, sf), subset)
    states = L.segment_states(pn, [*SEG, "center_sec"], len(SUBSETS[subset]))
    tagged = W.assign_states(states, intervals(spark, sf))
    cls = (F.right("label", F.lit(1)).cast("int") % 2).alias("label")
    split = K.ordered_split(tagged.select(*SEG, "amps", cls), ["session_id"], F.expr("win div 1024"), [F.col("win")])
    return materialise(split, "states")


def _fold(rows: str, by: str) -> str:
    """Product over channels of complex numbers (re, im)."""
    return f"select {by}, list_reduce(list({{'re': re, 'im': im}} order by channel_idx), lambda p, q: {{'re': p.re * q.re - p.im * q.im, 'im': p.re * q.im + p.im * q.re}}) g from {rows} group by all"


def templates_sql(channels: str) -> str:
    """sp_ (segment, class, is_train), te (class, m, norm) and fi (segment, class, fidelity)."""
    return with_(S_SQL, M_SQL, STATES_SQL, encoded_sql(62), _ENC_SQL) + f""", sg as (select * from am where channel_idx in ({channels}) qualify count(*) over (partition by session_id, win) = {len(channels.split(','))}),
  tg as (select q.session_id, win, right(iv.label, 1)::int % 2 as label from (select distinct session_id, win, (win * 62 + 125.0::double) / 125 ce from sg) q join iv on iv.session_id = q.session_id and ce >= onset_sec and ce < end_sec),
  sp_ as (select *, row_number() over (partition by session_id order by win) - 1 < floor(round(0.7 * count(*) over (partition by session_id), 9)) is_train from tg),
  fit as (select session_id, win, label from sp_ where is_train qualify row_number() over (partition by label order by md5(session_id || ':' || win), session_id, win) <= {L.MAX_TRAINING}),
  tr as (select sg.*, label from sg join fit using (session_id, win)),
  nd as (select x.label, x.session_id s1, x.win w1, y.session_id s2, y.win w2, x.channel_idx, {_DOT['re']} re, {_DOT['im']} im from tr x join tr y on x.label = y.label and x.channel_idx = y.channel_idx),
  te as (select label, sum(g.re) norm, round(sqrt(count(*)))::bigint m from ({_fold('nd', 'label, s1, w1, s2, w2')}) group by label),
  fd as (select y.session_id, y.win, x.label, x.session_id s1, x.win w1, x.channel_idx, {_DOT['re']} re, {_DOT['im']} im from tr x join sg y on x.channel_idx = y.channel_idx),
  fi as (select session_id, win, label, (pow(sum(g.re), 2) + pow(sum(g.im), 2)) / any_value(norm) f from ({_fold('fd', 'session_id, win, label, s1, w1')}) join te using (label) group by session_id, win, label) """


_FOUR, _ALL = "6, 7, 10, 11", ", ".join(map(str, range(16)))
_TEMPLATES = "select label, m n_segments, round(norm, 6) norm from te"
_SCORES = "select session_id, win, label, round(f, 6) fidelity from fi join (select session_id, win from sp_) using (session_id, win)"
_BEST = "select session_id, win, arg_max(label, f) prediction, round(max(f), 6) fidelity from fi join (select session_id, win from sp_) using (session_id, win) group by all"


def templates(spark, sf, subset="4"):
    return L.build_templates(split_states(spark, sf, subset).where("is_train"), ["label"], SEG)


def fidelities(spark, sf, subset="4"):
    states = split_states(spark, sf, subset)
    return L.template_fidelity(states.select(*SEG, "amps"), L.build_templates(states.where("is_train"), ["label"], SEG), SEG)


for _suffix, _subset, _channels in (("", "4", _FOUR), ("_16", "16", _ALL)):

    @query(f"l4_build_templates{_suffix}", templates_sql(_channels) + _TEMPLATES)
    def l4(spark, sf, subset=_subset):
        return pick(templates(spark, sf, subset), "label n_segments norm:6")

    @query(f"l5_template_fidelity{_suffix}", templates_sql(_channels) + _SCORES)
    def l5(spark, sf, subset=_subset):
        return pick(fidelities(spark, sf, subset), "session_id win label fidelity:6")

    @query(f"l6_classify_by_template{_suffix}", templates_sql(_channels) + _BEST)
    def l6(spark, sf, subset=_subset):
        return pick(L.classify(fidelities(spark, sf, subset), SEG), "session_id win prediction fidelity:6")
