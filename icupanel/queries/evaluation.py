"""Queries: splits, sweeps, curves, intervals, calibration, descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from icupanel.functions import scores as S
from icupanel.functions import targets as T

from icupanel.operators import evaluate as E

from icupanel.operators import splits as SP
from icupanel.operators import stats as ST
from icupanel.queries.base import CONCEPTS, LABELLED, PANEL, PREDICTIONS, STAYS, concepts, cuts_sql, filled, labelled, once, panel, predictions, query, rounded, stays, table
from icupanel.queries.panels import UTILITIES

N_CUTS = 100

def _h(seed, id="stay_id"):
    return f"CAST('0x' || substr(md5(CAST({seed} AS VARCHAR) || '|' || {id}), 1, 13) AS BIGINT)"

SPLITS = STAYS + f""", dealt AS (SELECT stay_id, label, row_number() OVER (PARTITION BY label ORDER BY {_h(42)}, stay_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM stays),
reps AS (SELECT stay_id, label, r <= ceil(n * 0.1::DOUBLE) AS test, n, CAST(rep AS INTEGER) AS rep FROM dealt, range(5) t(rep)),
splits AS (SELECT stay_id, label, rep, CASE WHEN test THEN 'test' WHEN row_number() OVER (PARTITION BY label, rep, test ORDER BY {_h('rep + 1')}, stay_id) <= ceil(n * 0.1::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM reps)
"""

@query("SELECT stay_id, label, rep, split FROM splits", SPLITS)
def stratified_split(spark, d):
    return SP.stratified_split(stays(spark, d))

@query(f", b AS (SELECT *, row_number() OVER (PARTITION BY label, rep ORDER BY {_h('rep + 7')}, stay_id) AS r, count(*) OVER (PARTITION BY label, rep) AS n FROM splits WHERE split = 'test') SELECT stay_id, label, rep, split FROM b WHERE r <= ceil(n * 0.8::DOUBLE)", SPLITS)
def test_boosts(spark, d):
    return SP.test_boosts(SP.stratified_split(stays(spark, d)))

@query(f"SELECT stay_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_h(0)}, stay_id) - 1) % 5 AS INTEGER) AS fold FROM stays", STAYS)
def patient_folds(spark, d):
    return SP.folds(stays(spark, d))

@query(f", v AS (SELECT *, row_number() OVER (PARTITION BY label, rep ORDER BY {_h(3)}, stay_id) AS r, count(*) OVER (PARTITION BY label, rep) AS n FROM splits WHERE split = 'validation') SELECT stay_id, label, rep, share FROM v, (VALUES (0.2::DOUBLE), (0.5::DOUBLE)) t(share) WHERE r <= ceil(n * share)", SPLITS)
def finetune_subsets(spark, d):
    return SP.fine_tuning_subsets(SP.stratified_split(stays(spark, d)))

@query(", parts AS (SELECT *, count(*) OVER (PARTITION BY rep, stay_id) AS p FROM splits) SELECT rep, split, count(*) AS stays, CAST(sum(label) AS BIGINT) AS cases, round(avg(label), 6) AS prevalence, count(*) FILTER (WHERE p > 1) AS shared FROM parts GROUP BY rep, split", SPLITS)
def split_checks(spark, d):
    return rounded(SP.split_checks(SP.stratified_split(stays(spark, d))))

_SUB = STAYS + f""", c AS (SELECT count(*) FILTER (WHERE label = 1) AS a, count(*) FILTER (WHERE label = 0) AS b FROM stays),
size AS (SELECT CAST(a / (a + b) > 0.188 AS INTEGER) AS over_label, CASE WHEN a / (a + b) > 0.188 THEN round(b * 0.188::DOUBLE / (1 - 0.188::DOUBLE)) ELSE round(a * (1 - 0.188::DOUBLE) / 0.188::DOUBLE) END AS size FROM c),
drawn AS (SELECT CAST(draw AS INTEGER) AS draw, stay_id, label, row_number() OVER (PARTITION BY draw, label ORDER BY {_h('draw + 123')}, stay_id) AS r FROM stays, range(10) t(draw)),
subsample AS (SELECT draw, stay_id, label FROM drawn, size WHERE label <> over_label OR r <= size)
"""

@query("SELECT draw, stay_id, label FROM subsample", _SUB)
def prevalence_subsample(spark, d):
    return SP.subsample(stays(spark, d))

@query(", p AS (SELECT stay_id, max(temp_raw) AS score FROM labelled GROUP BY stay_id) SELECT draw, count(*) AS stays, round(avg(label), 6) AS prevalence, round(avg(score), 6) AS mean_score FROM subsample JOIN p USING (stay_id) GROUP BY draw", _SUB)
def subsample_predictions(spark, d):
    p = labelled(spark, d).groupBy("stay_id").agg(F.max("temp_raw").alias("score"))
    return rounded(SP.subsample(stays(spark, d)).join(p, "stay_id").groupBy("draw").agg(F.count("*").alias("stays"), F.avg("label").alias("prevalence"), F.avg("score").alias("mean_score")))

@query("SELECT stay_id FROM stays WHERE label = 1 AND stay_id NOT IN (SELECT stay_id FROM subsample WHERE label = 1)", _SUB)
def subsample_coverage(spark, d):
    s = stays(spark, d)
    return s.where("label = 1").join(SP.subsample(s).where("label = 1"), "stay_id", "left_anti").select("stay_id")

_RES = STAYS + f""", c AS (SELECT count(*) FILTER (WHERE label = 1) AS a, count(*) FILTER (WHERE label = 0) AS b FROM stays), want AS (SELECT CAST(round(a * 0.75 / 0.25) AS BIGINT) AS w, b FROM c),
rk AS (SELECT stay_id, label, row_number() OVER (PARTITION BY label ORDER BY {_h(5)}, stay_id) AS r FROM stays),
k AS (SELECT stay_id, label, CASE WHEN label = 1 THEN 1 ELSE w // greatest(b, 1) + CAST(r <= w % greatest(b, 1) AS INTEGER) END AS n FROM rk, want),
units AS (SELECT stay_id || '_' || copy AS unit_id, stay_id, label FROM (SELECT stay_id, label, unnest(range(1, n + 1)) AS copy FROM k))
"""

@query("SELECT unit_id, stay_id, label FROM units", _RES)
def control_resampling(spark, d):
    return SP.resample_controls(stays(spark, d), 0.25)

@query("SELECT unit_id, count(*) AS n_rows, round(sum(hr_raw), 6) AS sum_hr FROM units JOIN panel USING (stay_id) GROUP BY unit_id", _RES)
def bootstrap_join(spark, d):
    draws = SP.resample_controls(stays(spark, d), 0.25)
    return rounded(SP.bootstrap(panel(spark, d), draws).groupBy("unit_id").agg(F.count("*").alias("n_rows"), F.sum("hr_raw").alias("sum_hr")))

_TRAIN = SPLITS + ", train AS (SELECT stay_id FROM splits WHERE rep = 0 AND split = 'train')\n"

@query("SELECT p.stay_id, count(*) AS n_rows FROM panel p WHERE p.stay_id IN (SELECT stay_id FROM train) GROUP BY p.stay_id", _TRAIN)
def split_semi_join(spark, d):
    ids = SP.stratified_split(stays(spark, d)).where("rep = 0 AND split = 'train'")
    return ST.rows_per_stay(panel(spark, d).join(ids.select("stay_id"), "stay_id", "left_semi"))

@query("SELECT c_custkey AS stay_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def lost_ids(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("stay_id")).join(table(spark, d, "orders").select(F.col("o_custkey").alias("stay_id")), "stay_id", "left_anti")

@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT user_id FROM events")
def id_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, d, "events").select("user_id"))

@query("SELECT DISTINCT user_id AS id FROM events")
def distinct_ids(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()

_NORM = _TRAIN + ", stat AS (SELECT avg(hr_raw) AS m1, stddev_samp(hr_raw) AS s1, avg(temp_raw) AS m2, stddev_samp(temp_raw) AS s2 FROM panel WHERE stay_id IN (SELECT stay_id FROM train))\n"

@query("SELECT 'hr_raw' AS \"column\", round(m1, 6) AS mean, round(CASE WHEN s1 < 0.01 THEN 1 ELSE s1 END, 6) AS std FROM stat UNION ALL SELECT 'temp_raw', round(m2, 6), round(CASE WHEN s2 < 0.01 THEN 1 ELSE s2 END, 6) FROM stat", _NORM)
def normaliser(spark, d):
    ids = SP.stratified_split(stays(spark, d)).where("rep = 0 AND split = 'train'")
    return rounded(ST.normaliser(panel(spark, d), ["hr_raw", "temp_raw"], ids))

@query("SELECT stay_id, stay_time, round((hr_raw - m1) / s1, 6) AS hr_raw, round((temp_raw - m2) / s2, 6) AS temp_raw FROM panel, stat", _NORM)
def zscore_split(spark, d):
    p = once(panel(spark, d).select("stay_id", "stay_time", "hr_raw", "temp_raw"), "panel")
    ids = SP.stratified_split(stays(spark, d)).where("rep = 0 AND split = 'train'")
    return rounded(ST.zscored(p, ST.normaliser(p, ["hr_raw", "temp_raw"], ids)))

@query("SELECT stay_id, stay_time, round(hr_raw, 6) AS hr_raw FROM panel", PANEL)
def zscore_round_trip(spark, d):
    p = panel(spark, d).select("stay_id", "stay_time", "hr_raw")
    s = ST.normaliser(p, ["hr_raw"])
    return rounded(ST.zscored(ST.zscored(p, s), s, inverse=True))

@query("SELECT stay_id, stay_time, round(hr_raw, 6) AS hr_raw, round((hr_raw - avg(hr_raw) OVER ()) / stddev_samp(hr_raw) OVER () + 1, 6) AS above FROM panel", PANEL)
def transform_on_normalised(spark, d):
    p = once(panel(spark, d).select("stay_id", "stay_time", "hr_raw"), "panel")
    return rounded(ST.on_normalised(p, ST.normaliser(p, ["hr_raw"]), [lambda x: x.withColumn("above", F.col("hr_raw") + 1)])).select("stay_id", "stay_time", "hr_raw", "above")

@query("SELECT stay_id, stay_time, round(coalesce(hr_raw, 0), 6) AS hr_raw, round(CASE WHEN coalesce(map_raw, 0) = 0 THEN 0 ELSE coalesce(hr_raw / map_raw, 0) END, 6) AS quotient FROM panel", PANEL)
def impute_clean(spark, d):
    q = F.when(F.col("map_raw") == 0, float("inf")).otherwise(F.try_divide("hr_raw", "map_raw"))
    return rounded(panel(spark, d).select("stay_id", "stay_time", S.finite_or_zero(F.col("hr_raw")).alias("hr_raw"), S.finite_or_zero(q).alias("quotient")))

# --- sweeps ---------------------------------------------------------------

_ALARMS = PREDICTIONS + ", " + cuts_sql(N_CUTS) + """, tops AS (SELECT stay_id, stay_time, label, max(score) OVER (PARTITION BY stay_id ORDER BY stay_time ROWS UNBOUNDED PRECEDING) AS top FROM predictions),
truth AS (SELECT stay_id, min(CASE WHEN label = 1 THEN stay_time END) AS onset FROM predictions GROUP BY stay_id),
alarms AS (SELECT thres_no, t.stay_id, onset, min(stay_time) AS alarm_time FROM tops t JOIN cuts ON top >= thres JOIN truth USING (stay_id) GROUP BY ALL),
totals AS (SELECT count(onset) AS cases, count(*) - count(onset) AS controls FROM truth),
per AS (SELECT thres_no, count(onset) AS tp, count(*) - count(onset) AS fp, avg(onset - alarm_time) AS em, quantile_cont(onset - alarm_time, 0.5) AS ed, min(onset - alarm_time) AS el, max(onset - alarm_time) AS eh,
""" + ", ".join(f"count(*) FILTER (WHERE onset - alarm_time > {k}) AS a{k}" for k in range(11)) + """ FROM alarms GROUP BY thres_no)
"""

def _cuts(p, n=N_CUTS):
    return [round(c, 6) for c in E.threshold_list(E.thresholds(p, n=n))]

@query("SELECT thres_no, thres, round(coalesce(tp, 0) / nullif(cases, 0), 6) AS pat_recall, round(coalesce(coalesce(tp, 0) / nullif(coalesce(tp, 0) + coalesce(fp, 0), 0), 0), 6) AS pat_precision, round(1 - coalesce(coalesce(fp, 0) / nullif(controls, 0), 0), 6) AS pat_specificity, "
       "round(em, 6) AS earliness_mean, round(ed, 6) AS earliness_median, el AS earliness_min, eh AS earliness_max, " + ", ".join(f"round(coalesce(coalesce(a{k}, 0) / nullif(cases, 0), 0), 6) AS proportion_{k}_hours_before_onset" for k in range(11))
       + " FROM cuts LEFT JOIN per USING (thres_no), totals", _ALARMS)
def first_alarm_sweep(spark, d):
    p = once(predictions(spark, d), "predictions")
    return rounded(E.patient_sweep(p, _cuts(p)))

@query("SELECT thres_no, round(coalesce(tp, 0) / nullif(cases, 0), 6) AS pat_recall, round(coalesce(coalesce(tp, 0) / nullif(coalesce(tp, 0) + coalesce(fp, 0), 0), 0), 6) AS pat_precision, round(1 - coalesce(coalesce(fp, 0) / nullif(controls, 0), 0), 6) AS pat_specificity, round(ed, 6) AS earliness_median FROM cuts LEFT JOIN per USING (thres_no), totals", _ALARMS.replace("top >= thres", "top > thres"))
def strict_alarm_sweep(spark, d):
    """Alarms only above a threshold, not at it."""
    p = once(predictions(spark, d), "predictions")
    return rounded(E.patient_sweep(p, _cuts(p), strict=True).select("thres_no", "pat_recall", "pat_precision", "pat_specificity", "earliness_median"))


_TP = PREDICTIONS + ", " + cuts_sql(N_CUTS) + """, pos AS (SELECT sum(label) AS p FROM predictions), g AS (SELECT score, sum(label) AS ones, count(*) AS n FROM predictions GROUP BY score),
tp AS (SELECT thres_no, thres, coalesce(sum(ones), 0) AS tp, coalesce(sum(n), 0) AS alarms FROM cuts LEFT JOIN g ON score >= thres GROUP BY ALL)
"""

@query("SELECT thres_no, thres, round(tp / nullif(p, 0), 6) AS tp_recall, round(coalesce(tp / nullif(alarms, 0), 0), 6) AS tp_precision FROM tp, pos", _TP)
def timepoint_sweep(spark, d):
    p = once(predictions(spark, d), "predictions")
    return rounded(E.timepoint_sweep(p, _cuts(p)))

_PEAKS = UTILITIES + PREDICTIONS[len(LABELLED):] + """, peaks AS (SELECT max(score) AS peak FROM predictions GROUP BY stay_id),
cut AS (""" + " UNION ALL ".join(f"SELECT {k} AS thres_no, round((SELECT quantile_cont(peak, {k / 20}) FROM peaks), 6) AS thres" for k in range(21)) + """),
u AS (SELECT score, u1 - u0 AS u FROM predictions JOIN utilities USING (stay_id, stay_time))
"""

@query("SELECT thres_no, thres, round(sum(CASE WHEN score > thres THEN u ELSE 0 END) / (SELECT sum(u) FROM u WHERE u > 0), 6) AS utility FROM cut, u GROUP BY ALL", _PEAKS)
def utility_sweep(spark, d):
    """Normalised utility at the quantiles of the stays' highest scores."""
    f = T.with_utilities(filled(spark, d)).select("stay_id", "utility", F.coalesce(F.round(F.least(F.lit(1.0), F.col("temp_locf") / 300), 6), F.lit(0.0)).alias("score"))
    f = once(f, "utilities")
    cuts = [round(c, 6) for c in E.threshold_list(E.peak_thresholds(f, n=21))]
    return rounded(E.utility_sweep(f, cuts))

@query("SELECT CAST(k AS INTEGER) AS thres_no, round(a + k * (b - a) / 9, 6) AS thres FROM (SELECT min(score) AS a, max(score) AS b FROM predictions), range(10) t(k)", PREDICTIONS)
def range_thresholds(spark, d):
    return rounded(E.range_thresholds(predictions(spark, d), n=10))

@query(", x AS (SELECT round(tp / nullif(p, 0), 6) AS r, round(coalesce(tp / nullif(alarms, 0), 0), 6) AS pr, thres FROM tp, pos), a AS (SELECT r, pr, thres FROM x WHERE r >= 0.8 ORDER BY r, pr, thres LIMIT 1), b AS (SELECT r, pr, thres FROM x WHERE r <= 0.8 ORDER BY r DESC, pr DESC, thres DESC LIMIT 1) "
       "SELECT round(b.pr + coalesce((0.8 - b.r) / nullif(a.r - b.r, 0), 0) * (a.pr - b.pr), 6) AS tp_precision, round(b.thres + coalesce((0.8 - b.r) / nullif(a.r - b.r, 0), 0) * (a.thres - b.thres), 6) AS thres FROM a, b", _TP)
def metrics_at_recall(spark, d):
    p = once(predictions(spark, d), "predictions")
    return rounded(E.at_recall(rounded(E.timepoint_sweep(p, _cuts(p))), "tp_recall", 0.8, ["tp_precision", "thres"]))

@query(", x AS (SELECT round(tp / nullif(p, 0), 6) AS r, round(coalesce(tp / nullif(alarms, 0), 0), 6) AS pr, thres FROM tp, pos) SELECT r AS tp_recall, thres, pr AS tp_precision FROM x WHERE r > 0.5 ORDER BY r, thres DESC LIMIT 1", _TP)
def operating_point(spark, d):
    p = predictions(spark, d)
    return E.operating_point(rounded(E.timepoint_sweep(p, _cuts(p))), "tp_recall", 0.5, ["tp_precision"])

_STEP = """, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM predictions GROUP BY score),
c AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pp, sum(q) OVER () AS qq FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT score, tp / pp AS tpr, fp / qq AS fpr, tp / (tp + fp) AS pr FROM c),
seg AS (SELECT *, lag(tpr, 1, 0.0) OVER w AS tpr0, lag(fpr, 1, 0.0) OVER w AS fpr0, lag(pr, 1, 1.0) OVER w AS pr0 FROM pts WINDOW w AS (ORDER BY score DESC))
"""

@query("SELECT round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS auroc, round(sum((tpr - tpr0) * (pr + pr0) / 2), 6) AS auprc, round(sum((tpr - tpr0) * pr), 6) AS average_precision FROM seg", PREDICTIONS + _STEP)
def auroc_auprc(spark, d):
    return rounded(E.auroc_auprc(predictions(spark, d)))

_QUALITY = "WITH predictions AS (SELECT l.doc_id AS stay_id, l.quality::DOUBLE AS label, round(n_chars / (SELECT max(n_chars) FROM documents), 6) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"

@query(_QUALITY + _STEP + "SELECT round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS auroc, round(sum((tpr - tpr0) * (pr + pr0) / 2), 6) AS auprc, round(sum((tpr - tpr0) * pr), 6) AS average_precision FROM seg")
def auroc_documents(spark, d):
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    most = docs.agg(F.max("n_chars")).first()[0]
    rows = lab.join(docs, "doc_id").select(F.col("quality").cast("double").alias("label"), F.round(F.col("n_chars") / most, 6).alias("score"))
    return rounded(E.auroc_auprc(rows))

@query(", c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn FROM predictions) "
       "SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f_measure, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c", PREDICTIONS)
def acc_f_measure(spark, d):
    return rounded(E.confusion(predictions(spark, d).withColumn("pred", (F.col("score") >= 0.5).cast("int")), "pred", "label"))

_GRID = _STEP + """, raw AS (SELECT fpr AS x, tpr AS y FROM pts UNION ALL SELECT 0.0, 0.0 UNION ALL SELECT 1.0, 1.0), one AS (SELECT x, max(y) AS y FROM raw GROUP BY x),
s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM one), steps AS (SELECT k, k / 199.0::DOUBLE AS g FROM range(200) t(k)),
curve AS (SELECT CAST(k AS INTEGER) AS grid_no, g, arg_max(y + coalesce((y1 - y) * (g - x) / (x1 - x), 0), x) AS y FROM steps JOIN s ON s.x <= g + 1e-12 GROUP BY k, g)
"""

@query("SELECT grid_no, round(g, 6) AS x, round(y, 6) AS y FROM curve", PREDICTIONS + _GRID)
def roc_grid(spark, d):
    c = E.score_counts(predictions(spark, d), "score", "label")
    pts = c.select(F.try_divide("fp", "negatives").alias("x"), F.try_divide("tp", "positives").alias("y"))
    return rounded(E.interpolated(pts, "x", "y"))

@query(", t AS (SELECT (g - lag(g) OVER (ORDER BY grid_no)) * (y + lag(y) OVER (ORDER BY grid_no)) / 2 AS a FROM curve) SELECT round(sum(a), 6) AS auc FROM t", PREDICTIONS + _GRID)
def roc_grid_auc(spark, d):
    c = E.score_counts(predictions(spark, d), "score", "label")
    pts = c.select(F.try_divide("fp", "negatives").alias("x"), F.try_divide("tp", "positives").alias("y"))
    return rounded(E.trapezoid(E.interpolated(pts, "x", "y")))

@query(", f AS (SELECT stay_id % 5 AS rep, least(stay_time // 24, 29) AS k, avg(score) AS y FROM predictions GROUP BY ALL) SELECT k, round(quantile_cont(y, 0.5), 6) AS median, round(min(y), 6) AS low, round(max(y), 6) AS high, round(avg(y), 6) AS mean FROM f GROUP BY k", PREDICTIONS)
def curve_bands(spark, d):
    c = predictions(spark, d).groupBy((F.col("stay_id") % 5).alias("rep"), F.least(F.floor(F.col("stay_time") / 24), F.lit(29)).alias("k")).agg(F.avg("score").alias("y"))
    return rounded(E.curve_bands(c, ["k"]))

@query("SELECT stay_id, stay_time, label, greatest(score, score2) AS score FROM predictions", PREDICTIONS)
def pooled_max(spark, d):
    p = predictions(spark, d)
    one = p.select("stay_id", "stay_time", "label", "score")
    two = p.select("stay_id", "stay_time", "label", F.col("score2").alias("score"))
    return E.pooled([one, two], ["stay_id", "stay_time", "label"]).drop("n_models")

@query("SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS share FROM predictions GROUP BY 1", PREDICTIONS)
def calibration_curve(spark, d):
    return rounded(E.calibration(predictions(spark, d)))

@query(", s AS (SELECT stay_id, avg(score) AS score, max(label) AS label FROM predictions GROUP BY stay_id) SELECT CAST(least(floor(score * 20), 19) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS share FROM s GROUP BY 1", PREDICTIONS)
def calibration_stays(spark, d):
    return rounded(E.calibration(E.to_stays(predictions(spark, d), "score", "label"), bins=20))

_TREAT = PREDICTIONS + ", treat AS (SELECT stay_id, stay_time AS treat_time FROM concepts WHERE concept = 'purchase' AND value > 150), al AS (SELECT p.stay_id, min(CASE WHEN score >= 0.6 THEN stay_time END) AS alarm, min(stay_time) AS first, max(stay_time) AS last, min(CASE WHEN label = 1 THEN stay_time END) AS onset FROM predictions p GROUP BY 1), tr AS (SELECT stay_id, min(treat_time) AS treated FROM treat GROUP BY 1), met AS (SELECT al.*, treated FROM al LEFT JOIN tr ON al.stay_id = tr.stay_id)\n"

def _treatments(spark, d):
    return concepts(spark, d).where("concept = 'purchase' AND value > 150").select("stay_id", F.col("stay_time").alias("treat_time"))

@query("SELECT count(*) FILTER (WHERE alarm < treated) AS before, count(*) FILTER (WHERE alarm >= treated) AS not_before, count(*) FILTER (WHERE alarm IS NULL) AS no_alarm, count(*) FILTER (WHERE treated IS NULL) AS untreated, round(avg(treated - alarm), 6) AS mean_lead FROM met", _TREAT)
def alarm_vs_treatment(spark, d):
    return rounded(E.alarm_against_treatment(predictions(spark, d), _treatments(spark, d), 0.6))

@query("SELECT h AS hour, count(*) FILTER (WHERE greatest(first, 0) <= h) - count(*) FILTER (WHERE last + 1 <= h) AS at_risk, count(*) FILTER (WHERE alarm <= h) AS alarmed, count(*) FILTER (WHERE treated <= h) AS treated, count(*) FILTER (WHERE onset <= h) AS onsets FROM met, range(100) t(h) GROUP BY h", _TREAT)
def alarm_hourly_counts(spark, d):
    return E.hourly_flow(predictions(spark, d), _treatments(spark, d), 0.6)

@query("SELECT stay_id, stay_time, max(CAST(score >= 0.6 AS INTEGER)) OVER (PARTITION BY stay_id ORDER BY stay_time ROWS UNBOUNDED PRECEDING) AS alarm FROM predictions", PREDICTIONS)
def sticky_alarm(spark, d):
    return E.sticky_alarm(predictions(spark, d), 0.6).select("stay_id", "stay_time", "alarm")

@query("SELECT stay_id, min(treat_time) AS treated FROM treat GROUP BY stay_id", _TREAT)
def first_treatment(spark, d):
    return _treatments(spark, d).groupBy("stay_id").agg(F.min("treat_time").alias("treated"))

_COIN = f"""CAST({_h('draw', "stay_id || '_' || stay_time")}::DOUBLE / 4503599627370496.0::DOUBLE < p AS INTEGER)"""

@query(f", e AS (SELECT p, CAST(draw AS INTEGER) AS draw, {_COIN} AS pred, label FROM predictions, (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) v(p), range(3) t(draw)) SELECT p, draw, count(*) AS n, CAST(sum(pred) AS BIGINT) AS alarms, round(sum(pred * label) / sum(label), 6) AS recall FROM e GROUP BY ALL", PREDICTIONS)
def random_predictions(spark, d):
    from icupanel.plans.models import random_predictions as rp

    e = rp(predictions(spark, d), [0.1, 0.5], 3)
    return rounded(e.groupBy("p", "draw").agg(F.count("*").alias("n"), F.sum("prediction").alias("alarms"), F.try_divide(F.sum(F.col("prediction") * F.col("label")), F.sum("label")).alias("recall")))

@query(", m AS (SELECT stay_id, count(*) AS n, max(score) AS top FROM predictions GROUP BY 1) SELECT stay_id, n, top, round((n - min(n) OVER ()) / nullif(max(n) OVER () - min(n) OVER (), 0), 6) AS n_scaled, round((top - min(top) OVER ()) / nullif(max(top) OVER () - min(top) OVER (), 0), 6) AS top_scaled FROM m", PREDICTIONS)
def min_max_scaling(spark, d):
    return rounded(E.min_max_scaled(predictions(spark, d).groupBy("stay_id").agg(F.count("*").alias("n"), F.max("score").alias("top")), ["n", "top"]))

# --- summaries ------------------------------------------------------------

#: An order's price as the metric of a run: nation of the customer trains, month evaluates, priority repeats.
_RUNS = "runs AS (SELECT c_nationkey % 5 AS train, c_custkey % 5 AS evaluation, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rep, floor(o_totalprice) / 1024 AS auc FROM orders JOIN customer ON o_custkey = c_custkey)\n"

def _runs(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_nationkey") % 5).alias("train"), (F.col("c_custkey") % 5).alias("evaluation"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rep"), (F.floor("o_totalprice") / 1024).alias("auc"))

@query("SELECT train, round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM runs GROUP BY train", _RUNS)
def bootstrap_ci(spark, d):
    return rounded(ST.percentile_interval(_runs(spark, d), "auc", ["train"]))

@query("SELECT train, round(avg(auc), 6) AS mean, round(avg(auc) - 1.96 * stddev_pop(auc), 6) AS low, round(avg(auc) + 1.96 * stddev_pop(auc), 6) AS high FROM runs GROUP BY train", _RUNS)
def gaussian_ci(spark, d):
    return rounded(ST.gaussian_interval(_runs(spark, d), "auc", ["train"]))

@query(", m AS (SELECT rep, evaluation, avg(auc) AS auc FROM runs GROUP BY ALL) SELECT round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM m", _RUNS)
def mean_of_means_ci(spark, d):
    return rounded(ST.mean_of_means_interval(_runs(spark, d), "auc", ["rep", "evaluation"]))

@query("SELECT train, evaluation, round(avg(auc), 6) AS mean, round(stddev_samp(auc), 6) AS std, round(stddev_pop(auc), 6) AS std_pop FROM runs GROUP BY ALL", _RUNS)
def rep_mean_std(spark, d):
    return rounded(ST.mean_std(_runs(spark, d), "auc", ["train", "evaluation"]))

@query(", u AS (SELECT train, rep, avg(auc) AS m, sum(auc) AS s, count(auc) AS n FROM runs GROUP BY ALL) SELECT train, round(avg(m), 6) AS macro, round(sum(s) / sum(n), 6) AS micro FROM u GROUP BY train", _RUNS)
def macro_micro(spark, d):
    return rounded(ST.macro_micro(_runs(spark, d), "auc", ["rep"], ["train"]))

@query(", m AS (SELECT train, rep, max(auc) AS auc FROM runs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY auc DESC, train) AS k FROM m) SELECT rep, round(auc, 6) AS best, train AS best_name FROM r WHERE k = 1", _RUNS)
def best_per_group(spark, d):
    m = _runs(spark, d).groupBy("train", "rep").agg(F.max("auc").alias("auc"))
    return rounded(ST.best_per_group(m, ["rep"], "auc", "train"))

@query("SELECT train, " + ", ".join(f'round(avg(auc) FILTER (WHERE evaluation = {k}), 6) AS "{k}"' for k in range(5)) + " FROM runs GROUP BY train", _RUNS)
def metric_matrix(spark, d):
    return rounded(ST.metric_matrix(_runs(spark, d), "train", "evaluation", "auc", list(range(5))))

@query(", own AS (SELECT evaluation, avg(auc) AS o FROM runs WHERE train = evaluation GROUP BY 1) SELECT train, round(avg(auc) FILTER (WHERE train = r.evaluation), 6) AS internal, round(avg(auc) FILTER (WHERE train <> r.evaluation), 6) AS \"external\", round(avg(auc / o) FILTER (WHERE train <> r.evaluation), 6) AS relative FROM runs r LEFT JOIN own ON r.evaluation = own.evaluation GROUP BY train", _RUNS)
def internal_external(spark, d):
    return rounded(ST.internal_external(_runs(spark, d), "train", "evaluation", "auc"))

@query("SELECT train, evaluation, round(avg(auc), 6) AS weight FROM runs WHERE train <> evaluation GROUP BY ALL", _RUNS)
def result_edges(spark, d):
    return rounded(ST.edges(_runs(spark, d), "train", "evaluation", "auc"))

@query("SELECT train, round(sum(auc * rep) / sum(rep), 6) AS mean FROM runs GROUP BY train", _RUNS)
def weighted_lambda(spark, d):
    return rounded(ST.weighted_mean(_runs(spark, d), "auc", "rep", ["train"]))

@query(", dd AS (SELECT score - score2 AS d FROM predictions), t AS (SELECT count(*) AS n, avg(d) AS m, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM dd), g AS (SELECT abs(d) AS s, count(*) AS k, count(*) FILTER (WHERE d > 0) AS u FROM dd WHERE d <> 0 GROUP BY abs(d)), "
       "r AS (SELECT u, k, coalesce(sum(k) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS r FROM g), w AS (SELECT sum(u * r) AS w, sum(k) AS m FROM r) "
       "SELECT n, round(t.m, 6) AS mean_difference, round(t, 4) AS t, w::DOUBLE AS w, round((w - w.m * (w.m + 1) / 4) / sqrt(w.m * (w.m + 1) * (2 * w.m + 1) / 24), 4) AS z FROM t, w", PREDICTIONS)
def paired_tests(spark, d):
    p = predictions(spark, d)
    return ST.paired_tests(p, "score", "score2").select("n", F.round("mean_difference", 6).alias("mean_difference"), F.round("t", 4).alias("t"), F.col("w").cast("double").alias("w"), F.round("z", 4).alias("z"))

@query(", v AS (SELECT value, count(*) FILTER (WHERE stay_id % 2 = 0) AS a, count(*) FILTER (WHERE stay_id % 2 = 1) AS b FROM concepts GROUP BY value), s AS (SELECT a, b, abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS d FROM v WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING)) "
       "SELECT round(max(d), 6) AS statistic, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM s", CONCEPTS)
def ks_two_sample(spark, d):
    return rounded(ST.ks_two_sample(concepts(spark, d).withColumn("even", F.col("stay_id") % 2 == 0), "even", "value"))

@query("SELECT stay_id, count(*) AS n_rows FROM concepts GROUP BY stay_id", CONCEPTS)
def rows_per_stay(spark, d):
    return ST.rows_per_stay(concepts(spark, d))

@query("SELECT stay_id, label FROM stays", STAYS)
def stay_label(spark, d):
    return ST.stay_labels(labelled(spark, d))

@query(", s AS (SELECT c_nationkey AS site, l.stay_id, max(sep3) AS c, count(sep3) AS n, sum(sep3) AS o FROM labelled l JOIN customer ON l.stay_id = c_custkey GROUP BY ALL) SELECT site, count(*) AS stays, CAST(sum(c) AS BIGINT) AS cases, CAST(sum(n) AS BIGINT) AS time_points, round(sum(o) / sum(n), 6) AS time_prevalence, round(avg(c), 6) AS case_prevalence FROM s GROUP BY site", LABELLED)
def dataset_stats(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("_c"), F.col("c_nationkey").alias("site"))
    return rounded(ST.prevalence(labelled(spark, d).join(c, F.col("stay_id") == F.col("_c")), ["site"]))

@query(", s AS (SELECT stay_id, count(*) AS n, max(sep3) AS c, avg(sep3) AS o FROM labelled GROUP BY 1), g AS (SELECT *, 'all' AS grp FROM s UNION ALL SELECT *, CASE WHEN c = 1 THEN 'case' ELSE 'control' END FROM s) "
       "SELECT grp AS \"group\", count(*) AS stays, round(avg(n), 6) AS mean_length, round(stddev_samp(n), 6) AS std_length, quantile_cont(n, 0.5) AS median_length, round(avg(o), 6) AS mean_ones FROM g GROUP BY grp", LABELLED)
def imbalance_report(spark, d):
    return rounded(ST.imbalance(labelled(spark, d)))

@query("SELECT round((1 - avg(sep3)) / avg(sep3), 6) AS factor FROM labelled", LABELLED)
def imbalance_factor(spark, d):
    return rounded(ST.imbalance_factor(labelled(spark, d), "sep3"))

_MI = "count(v) AS n, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75"

@query(f"SELECT segment, variable, {_MI} FROM (SELECT segment, 'balance' AS variable, balance AS v FROM stays UNION ALL SELECT segment, 'age', age::DOUBLE FROM stays) GROUP BY ALL", STAYS)
def median_iqr(spark, d):
    return rounded(ST.median_iqr(stays(spark, d).withColumn("age", F.col("age").cast("double")), ["balance", "age"], ["segment"]))

@query(f", e AS (SELECT * FROM panel WHERE stay_time <= 24) SELECT variable, {_MI}, round(count(v) / (SELECT count(DISTINCT stay_id) FROM e), 6) AS per_stay FROM (SELECT 'hr_raw' AS variable, hr_raw AS v FROM e UNION ALL SELECT 'temp_raw', temp_raw FROM e) GROUP BY variable", PANEL)
def early_measurements(spark, d):
    return rounded(ST.counts_per_stay(panel(spark, d), ["hr_raw", "temp_raw"]))

@query("SELECT label, segment, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS percent FROM stays GROUP BY label, segment", STAYS)
def level_percent(spark, d):
    return rounded(ST.level_percent(stays(spark, d), "segment", ["label"]))

@query(", t AS (SELECT site % 3 AS src, segment AS v, CAST(count(*) AS VARCHAR) AS s FROM stays GROUP BY ALL) SELECT v AS variable, " + ", ".join(f"coalesce(max(s) FILTER (WHERE src = {k}), '-') AS \"{k}\"" for k in range(3)) + " FROM t GROUP BY v", STAYS)
def characteristics_table(spark, d):
    t = stays(spark, d).groupBy((F.col("site") % 3).alias("src"), F.col("segment").alias("variable")).agg(F.count("*").cast("string").alias("s"))
    return ST.characteristics(t, "src", "variable", "s", [0, 1, 2])

@query("SELECT stay_id, max(CAST(concept = 'error' AND value > 300 AS INTEGER)) AS high_error, max(CAST(concept = 'signup' AS INTEGER)) AS signed_up FROM concepts GROUP BY stay_id", CONCEPTS)
def ever_flags(spark, d):
    return ST.ever(concepts(spark, d), {"high_error": (F.col("concept") == "error") & (F.col("value") > 300), "signed_up": F.col("concept") == "signup"})

@query("SELECT p_size AS stay_id, max(CAST(trim(split_part(p_type, ',', 1)) LIKE 'STANDARD%' OR trim(split_part(p_type, ',', 1)) LIKE 'SMALL%' AS INTEGER)) AS group_a, max(CAST(trim(split_part(p_type, ',', 1)) LIKE 'PROMO%' AS INTEGER)) AS group_b FROM part GROUP BY p_size")
def comorbidity_flags(spark, d):
    return ST.code_flags(table(spark, d, "part").withColumnRenamed("p_size", "stay_id"), "p_type", {"group_a": ["STANDARD", "SMALL"], "group_b": ["PROMO"]})

@query("SELECT sep3, count(hr_raw) AS n, round(stddev_samp(hr_raw), 6) AS std FROM labelled GROUP BY sep3", LABELLED)
def grouped_std(spark, d):
    return rounded(ST.grouped_std(labelled(spark, d), "sep3", "hr_raw"))

@query("SELECT sep3, count(hr_raw) AS n, round(stddev_samp(hr_raw), 6) AS std FROM labelled WHERE stay_time <= 24 OR sep3 = 1 GROUP BY sep3", LABELLED)
def grouped_std_window(spark, d):
    """Deviations in the first day, and from onset on."""
    return rounded(ST.grouped_std(labelled(spark, d), "sep3", "hr_raw", (F.col("stay_time") <= 24) | (F.col("sep3") == 1)))

@query(", per AS (SELECT stay_id, count(*) AS length, count(*) FILTER (WHERE sep3 = 1) AS ones, count(*) FILTER (WHERE sep3 = 0) AS zeros FROM labelled GROUP BY stay_id), v AS (SELECT rep, split, count(hr_raw) AS n, avg(hr_raw) AS mean, stddev_samp(hr_raw) AS std FROM splits JOIN labelled USING (stay_id) GROUP BY ALL), c AS (SELECT rep, split, count(*) AS stays, avg(length) AS mean_length, CAST(sum(ones) AS BIGINT) AS ones, CAST(sum(zeros) AS BIGINT) AS zeros FROM splits JOIN per USING (stay_id) GROUP BY ALL) "
       "SELECT rep, split, stays, round(mean_length, 6) AS mean_length, ones, zeros, n, round(mean, 4) AS mean, round(std, 4) AS std FROM c JOIN v USING (rep, split)", SPLITS)
def split_distribution(spark, d):
    out = rounded(ST.split_distribution(labelled(spark, d), SP.stratified_split(stays(spark, d)), "hr_raw"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})

@query("SELECT label, count(*) AS stays, round(avg(onset), 6) AS mean_onset, min(onset) AS first_onset, max(onset) AS last_onset, round(avg(outtime), 6) AS mean_end FROM stays GROUP BY label", STAYS)
def onset_times(spark, d):
    return rounded(ST.onset_times(stays(spark, d)))

@query("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS stays, 7 AS columns, max(n) AS most, min(n) AS least FROM (SELECT count(*) AS n FROM panel GROUP BY stay_id)", PANEL)
def shape_report(spark, d):
    return ST.shape(panel(spark, d))

@query("SELECT label, CAST(least(greatest(floor((outtime - 600.0) / 12.0), 0), 9) AS INTEGER) AS bin, count(*) AS n FROM stays WHERE outtime IS NOT NULL GROUP BY ALL", STAYS)
def length_histogram(spark, d):
    return ST.histogram(stays(spark, d), "outtime", 600, 720, 10, ["label"])

@query("SELECT n AS rows, c AS \"column\", m AS missing, round(m / n, 6) AS share FROM (SELECT count(*) AS n, unnest(['hr_raw', 'temp_raw']) AS c, unnest([count(*) - count(hr_raw), count(*) - count(temp_raw)]) AS m FROM panel)", PANEL)
def missing_report(spark, d):
    return rounded(ST.missing_report(panel(spark, d), ["hr_raw", "temp_raw"]))

@query(", a AS (SELECT concept, stay_id % 4 AS src, CASE WHEN count(CASE WHEN value > 480 AND stay_id % 4 = 1 OR stay_id % 4 <> 1 THEN value END) > 0 THEN 'yes' ELSE 'no' END AS has FROM concepts GROUP BY ALL) SELECT concept, " + ", ".join(f"coalesce(max(has) FILTER (WHERE src = {k}), 'unknown') AS \"{k}\"" for k in range(5)) + " FROM a GROUP BY concept", CONCEPTS)
def availability_matrix(spark, d):
    c = concepts(spark, d).withColumn("src", F.col("stay_id") % 4).withColumn("value", F.expr("CASE WHEN (value > 480 AND src = 1) OR src <> 1 THEN value END"))
    return ST.availability(c, "src", [0, 1, 2, 3, 4])

# --- attributions: a line item's price share is the attribution of its part's brand ---

_ATTR = "attr AS (SELECT l_linenumber AS run, l_orderkey % 1000 AS stay_id, l_orderkey // 1000 AS stay_time, p_brand AS feature, floor(l_extendedprice) * CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END AS shap FROM lineitem JOIN part ON l_partkey = p_partkey), per AS (SELECT run, feature, avg(abs(shap)) AS m, max(abs(shap)) AS top FROM attr GROUP BY ALL), ranks AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY m DESC) AS rk FROM per)\n"

def _attr(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    sign = F.when(F.col("l_partkey") % 2 == 0, 1).otherwise(-1)
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_linenumber").alias("run"), (F.col("l_orderkey") % 1000).alias("stay_id"), F.floor(F.col("l_orderkey") / 1000).alias("stay_time"), F.col("p_brand").alias("feature"), (F.floor("l_extendedprice") * sign).cast("double").alias("shap"))

@query("SELECT run, feature, round(m, 6) AS mean_abs, top AS largest_abs, CAST(rk AS INTEGER) AS rank FROM ranks", _ATTR)
def attribution_rank(spark, d):
    return rounded(ST.attribution(_attr(spark, d))).select("run", "feature", "mean_abs", F.abs("largest").alias("largest_abs"), "rank")

@query("SELECT feature, round(avg(rk), 6) AS mean_rank, round(avg(m), 6) AS mean_abs, round(stddev_samp(m), 6) AS std_abs FROM ranks GROUP BY feature ORDER BY avg(rk), feature LIMIT 20", _ATTR)
def top_features(spark, d):
    return rounded(ST.top_features(ST.attribution(_attr(spark, d))))

@query("SELECT feature, " + ", ".join(f"CAST(max(rk) FILTER (WHERE run = {k}) AS INTEGER) AS run_{k}" for k in range(1, 8)) + " FROM ranks GROUP BY feature", _ATTR)
def ranking_merge(spark, d):
    """Rankings of all seven runs side by side."""
    r = ST.attribution(_attr(spark, d))
    return ST.merged_rankings({f"run_{k}": r.where(F.col("run") == k) for k in range(1, 8)})

@query(", tail AS (SELECT *, max(stay_time) OVER (PARTITION BY run, stay_id) AS t FROM attr), p2 AS (SELECT run, feature, avg(abs(shap)) AS m FROM tail WHERE stay_time > t - 5 GROUP BY ALL) SELECT run, feature, round(m, 6) AS mean_abs, CAST(rank() OVER (PARTITION BY run ORDER BY m DESC) AS INTEGER) AS rank FROM p2", _ATTR)
def attribution_tail(spark, d):
    return rounded(ST.attribution(_attr(spark, d), hours=5).drop("largest"))

@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def dedupe_keep_last(spark, d):
    return ST.keep_last(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")

