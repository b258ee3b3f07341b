"""Queries: panels, windows, scores, labels, targets, cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from icupanel.functions import scores as S
from icupanel.functions import targets as T
from icupanel.functions import windows as W
from icupanel.operators import cohort as C
from icupanel.operators import panel as P
from icupanel.queries.base import CONCEPTS, FILLED, LABELLED, LOCF, ONSETS, PANEL, RAW, STAYS, concepts, filled, labelled, panel, query, rounded, stays, table

_BY = "PARTITION BY stay_id ORDER BY stay_time"


@query("SELECT stay_id, stay_time, " + ", ".join(f"round({c}, 6) AS {c}" for c in RAW) + " FROM panel", PANEL)
def panel_hourly(spark, d):
    return rounded(panel(spark, d))


@query("SELECT stay_id, CAST(lo AS BIGINT) AS first_time, CAST(hi AS BIGINT) AS last_time FROM bounds", PANEL)
def stay_window(spark, d):
    return P.stay_bounds(concepts(spark, d))


@query("SELECT stay_id, stay_time, " + ", ".join(f"round({c}, 6) AS {c}" for c in LOCF) + " FROM filled", FILLED)
def panel_locf(spark, d):
    return rounded(filled(spark, d).select("stay_id", "stay_time", *LOCF))


_RUNS = """, marked AS (SELECT stay_id, stay_time, coalesce(hr_raw, map_raw, sbp_raw, resp_raw, temp_raw) IS NULL AS gap FROM panel WHERE stay_time > 0),
islands AS (SELECT *, stay_time - row_number() OVER (PARTITION BY stay_id, gap ORDER BY stay_time) AS island FROM marked),
runs AS (SELECT stay_id, min(stay_time) AS run_start, count(*) AS run_length FROM islands WHERE gap GROUP BY stay_id, island)
"""


@query(_RUNS + "SELECT * FROM runs", PANEL)
def missing_runs(spark, d):
    return C.missing_runs(panel(spark, d).where("stay_time > 0"), RAW)


@query(_RUNS + "SELECT stay_id, count(*) AS n_rows FROM panel WHERE stay_id NOT IN (SELECT stay_id FROM runs WHERE run_length > 24) GROUP BY stay_id", PANEL)
def without_long_gaps(spark, d):
    from icupanel.operators.stats import rows_per_stay

    return rows_per_stay(C.without_long_gaps(panel(spark, d), RAW, 24))


@query("SELECT stay_id, stay_time, " + ", ".join(
    f"CAST({c} IS NULL AS INTEGER) AS {b}_indicator, count({c}) OVER w AS {b}_count, CAST({c} IS NOT NULL AS INTEGER) AS {b}_ind, CAST(sum(CAST({c} IS NOT NULL AS INTEGER)) OVER w AS BIGINT) AS {b}_cnt"
    for c, b in ((c, c[:-4]) for c in RAW)) + f" FROM panel WINDOW w AS ({_BY} ROWS UNBOUNDED PRECEDING)", PANEL)
def counts_indicators(spark, d):
    out = W.observed_and_counts(W.missing_and_counts(panel(spark, d), RAW), RAW)
    return out.drop(*RAW)


_STAT = {"min": "min({c})", "max": "max({c})", "mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "var": "var_samp({c})"}


def _lookback_sql(stats, name):
    cols = [f"round({_STAT[s].format(c=c)} OVER w{w}, 6) AS " + name.format(b=c[:-4], s=s, w=w) for c in ("hr_raw", "temp_raw") for w in (4, 8, 16) for s in stats]
    frames = ", ".join(f"w{w} AS ({_BY} ROWS {w - 1} PRECEDING)" for w in (4, 8, 16))
    return f"SELECT stay_id, stay_time, {', '.join(cols)} FROM panel WINDOW {frames}"


@query(_lookback_sql(("min", "max", "mean", "median", "var"), "{b}_{s}_{w}_hours"), PANEL)
def lookback_4_8_16(spark, d):
    return rounded(W.lookback(panel(spark, d), ["hr_raw", "temp_raw"]).drop(*RAW))


@query(_lookback_sql(("min", "max", "mean", "var"), "{b}_{s}{w}lbk"), PANEL)
def lookback_lbk(spark, d):
    return rounded(W.lookback_lbk(panel(spark, d), ["hr_raw", "temp_raw"]).drop(*RAW))


@query(f"SELECT stay_id, stay_time, round(hr_raw * 2, 6) AS hr_double, round(avg(hr_raw) OVER (PARTITION BY stay_id), 6) AS hr_staymean, round(max(hr_raw) OVER ({_BY} ROWS 5 PRECEDING), 6) AS hr_max6 FROM panel", PANEL)
def augment_columns(spark, d):
    out = W.augment(panel(spark, d), lambda c: F.col(c) * 2, "double", ["hr_raw"])
    out = W.augment(out, F.avg, "staymean", ["hr_raw"], by=["stay_id"])
    return rounded(W.augment(out, F.max, "max6", ["hr_raw"], rows=6).drop(*RAW))


# the panel's few variables stand in for those that the scores ask for
_STAND_INS = {"plt": ("map_locf", 1), "bili": ("temp_locf", 50), "crea": ("resp_locf", 100), "pco2": ("hr_locf", 4), "wbc": ("map_locf", 20), "lact": ("temp_locf", 100), "bun": ("resp_locf", 1), "po2": ("hr_locf", 1), "fio2": ("map_locf", 1)}
_INPUTS = FILLED + ", inputs AS (SELECT stay_id, stay_time, hr_locf AS hr, sbp_locf AS sbp, temp_locf AS temp, resp_locf AS resp, map_locf AS map_, " + ", ".join(f"{c} / {k} AS {v}" for v, (c, k) in _STAND_INS.items()) + " FROM filled)\n"


def _p(*terms):
    return " + ".join(f"coalesce(CAST(({c}) AS INTEGER), 0) * {n}.0" for c, n in terms)


_SOFA = _p(("plt >= 100 AND plt < 150", 1), ("plt >= 50 AND plt < 100", 2), ("plt >= 20 AND plt < 50", 3), ("plt < 20", 4), ("bili >= 1.2 AND bili <= 1.9", 1), ("bili > 1.9 AND bili <= 5.9", 2), ("bili > 5.9 AND bili <= 11.9", 3), ("bili > 11.9", 4), ("map_ < 70", 1), ("crea >= 1.2 AND crea <= 1.9", 1), ("crea > 1.9 AND crea <= 3.4", 2), ("crea > 3.4 AND crea <= 4.9", 3), ("crea > 4.9", 4))
_MEWS = _p(("sbp <= 70", 3), ("sbp > 70 AND sbp <= 80", 2), ("sbp > 80 AND sbp <= 100", 1), ("sbp >= 200", 2), ("hr > 40 AND hr <= 50", 1), ("hr > 100 AND hr <= 110", 1), ("hr > 110 AND hr < 130", 2), ("hr >= 130", 3), ("resp < 9", 2), ("resp > 15 AND resp <= 20", 1), ("resp > 20 AND resp < 30", 2), ("resp >= 30", 3), ("temp < 35", 2), ("temp >= 38.5", 2))
_SIRS = _p(("coalesce(temp > 38, false) OR coalesce(temp < 36, false)", 1), ("hr > 90", 1), ("coalesce(resp > 20, false) OR coalesce(pco2 < 32, false)", 1), ("coalesce(wbc < 4, false) OR coalesce(wbc > 12, false)", 1))


def _scored(spark, d):
    return S.add_scores(filled(spark, d).withColumns({f"{v}_locf": F.col(c) / k for v, (c, k) in _STAND_INS.items()}))


@query(f"""SELECT stay_id, stay_time, CAST({_SOFA} AS DOUBLE) AS "SOFA_derived", CAST({_p(("resp >= 22", 1), ("sbp <= 100", 1))} AS DOUBLE) AS "qSOFA_derived",
CAST({_p(("map_ < 65", 1), ("lact > 2", 1))} AS DOUBLE) AS "SepticShock_derived", CAST({_MEWS} AS DOUBLE) AS "MEWS_derived", CAST(({_SIRS}) >= 2 AS INTEGER)::DOUBLE AS "SIRS_derived" FROM inputs""", _INPUTS)
def severity_scores(spark, d):
    return _scored(spark, d).select("stay_id", "stay_time", "SOFA_derived", "qSOFA_derived", "SepticShock_derived", "MEWS_derived", "SIRS_derived")


@query(f""", scored AS (SELECT *, CAST({_SOFA} AS DOUBLE) AS sofa FROM inputs)
SELECT stay_id, stay_time, round(hr / nullif(sbp, 0), 6) AS "ShockIndex_derived", round(bun / nullif(crea, 0), 6) AS bun_cr_derived, round(po2 / nullif(fio2, 0), 6) AS po2_fio2_derived,
greatest(sofa - min(sofa) OVER ({_BY} ROWS 23 PRECEDING), 0.0) AS rise, sofa - min(sofa) OVER ({_BY} ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) AS rise_before,
CAST(sofa - min(sofa) OVER ({_BY} ROWS 23 PRECEDING) >= 2 AS INTEGER) AS risen, sofa - min(sofa) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS over_least FROM scored""", _INPUTS)
def score_ratios(spark, d):
    s = F.col("SOFA_derived")
    return rounded(_scored(spark, d).select(
        "stay_id", "stay_time", "ShockIndex_derived", "bun_cr_derived", "po2_fio2_derived", W.deterioration(s).alias("rise"), W.deterioration_before(s).alias("rise_before"),
        W.deteriorated(s).alias("risen"), W.delta_cummin(s).alias("over_least")))


@query("SELECT stay_id, stay_time, position, onset, onset_delta, onset_position, is_case FROM onsets", ONSETS)
def onset_delta(spark, d):
    return P.add_onset(labelled(spark, d)).select("stay_id", "stay_time", "position", "onset", "onset_delta", "onset_position", "is_case")


@query("SELECT stay_id, stay_time, CASE WHEN onset IS NULL THEN sep3 WHEN stay_time BETWEEN onset - 6 AND onset + 24 THEN 1.0 ELSE 0.0 END::DOUBLE AS shifted FROM onsets", ONSETS)
def label_shift(spark, d):
    return P.shift_label(labelled(spark, d)).select("stay_id", "stay_time", "shifted")


@query("SELECT stay_id, stay_time, sep3 FROM onsets WHERE stay_time > onset AND sep3 = 0", ONSETS)
def onset_violations(spark, d):
    return P.onset_violations(labelled(spark, d))


@query(", thin AS (SELECT stay_id, stay_time, CASE WHEN temp_raw IS NULL THEN NULL ELSE sep3 END AS sep3 FROM labelled) SELECT stay_id, stay_time, "
       f"coalesce(last_value(sep3 IGNORE NULLS) OVER ({_BY} ROWS UNBOUNDED PRECEDING), 0.0)::DOUBLE AS sep3 FROM thin", LABELLED)
def label_locf(spark, d):
    thin = labelled(spark, d).withColumn("sep3", F.when(F.col("temp_raw").isNotNull(), F.col("sep3")))
    return P.label_locf(thin).select("stay_id", "stay_time", "sep3")


@query("SELECT stay_id, CAST(min(CASE WHEN sep3 = 1 THEN stay_time + 1 END) - 1 + 6 AS BIGINT) AS onset FROM labelled GROUP BY stay_id", LABELLED)
def challenge_label(spark, d):
    return P.challenge_onset(labelled(spark, d).withColumn("hour", F.col("stay_time") + 1), "sep3", "hour")


@query("SELECT DISTINCT stay_id, stay_time FROM (SELECT o_custkey AS stay_id, unnest(range(o_orderkey % 50, o_orderkey % 50 + o_orderkey % 7 + 1)) AS stay_time FROM orders)")
def interval_hours(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("stay_id"), (F.col("o_orderkey") % 50).alias("a"), (F.col("o_orderkey") % 50 + F.col("o_orderkey") % 7).alias("b"))
    return P.interval_hours(o, "a", "b").select("stay_id", "stay_time")


@query("SELECT stay_id, CAST(floor(stay_time / 6.0) * 6 AS BIGINT) AS block, count(*) AS n, count(hr_raw) AS n_hr FROM panel GROUP BY ALL", PANEL)
def time_resolution(spark, d):
    return panel(spark, d).groupBy("stay_id", P.to_resolution(F.col("stay_time"), 6).cast("long").alias("block")).agg(F.count("*").alias("n"), F.count("hr_raw").alias("n_hr"))


_SCALES = [1 / (168 ** (i / 3)) for i in range(4)]


@query("SELECT stay_id, stay_time, " + ", ".join(f"round({f}(stay_time * {s!r}), 6) AS {f}{i}" for f in ("sin", "cos") for i, s in enumerate(_SCALES)) + " FROM panel", PANEL)
def time_encoding(spark, d):
    cols = S.time_encoding(F.col("stay_time"), 8)
    return panel(spark, d).select("stay_id", "stay_time", *[F.round(c, 6).alias(f"{f}{i}") for c, (f, i) in zip(cols, [(f, i) for f in ("sin", "cos") for i in range(4)])])


@query("SELECT stay_id, CAST(count(*) AS INTEGER) AS length, CAST(sum(stay_time) AS BIGINT) AS sum_times, CAST(count(hr_raw) AS BIGINT) AS n_hr, CAST(greatest(800, count(*)) AS INTEGER) AS padded FROM panel GROUP BY stay_id", PANEL)
def instance_arrays(spark, d):
    out = P.instances(panel(spark, d), ["hr_raw"], length=800)
    total = F.aggregate("stay_times", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return out.select("stay_id", "length", total.alias("sum_times"), F.size(F.filter("hr_raw", lambda x: x.isNotNull())).cast("long").alias("n_hr"), F.size("hr_raw").alias("padded"))


@query(f"SELECT stay_id, stay_time, count(*) OVER w AS seen_rows, round(coalesce(sum(hr_raw) OVER w, 0), 6) AS seen_sum FROM panel WINDOW w AS ({_BY} ROWS UNBOUNDED PRECEDING)", PANEL)
def prefix_expand(spark, d):
    out = P.prefixes(panel(spark, d), "hr_raw")
    total = F.aggregate("seen", F.lit(0.0), lambda a, x: a + F.when(F.isnan(x), 0.0).otherwise(x))
    return out.select("stay_id", "stay_time", F.size("seen").cast("long").alias("seen_rows"), F.round(total, 6).alias("seen_sum"))


@query("SELECT a.stay_id, a.stay_time, 'a' AS only_in FROM panel a LEFT JOIN wide w USING (stay_id, stay_time) WHERE w.stay_id IS NULL", PANEL)
def alignment_violations(spark, d):
    return P.alignment_violations(panel(spark, d), P.to_panel(concepts(spark, d), {"view": "hr_raw"}, grid=False).select("stay_id", "stay_time").unionByName(concepts(spark, d).select("stay_id", "stay_time")).distinct())


@query("SELECT * FROM (SELECT stay_id, unnest(['hr_raw', 'temp_raw']) AS \"column\", unnest([count(*) - count(hr_raw), count(*) - count(temp_raw)]) AS n FROM panel GROUP BY stay_id) WHERE n > 0", PANEL)
def value_violations(spark, d):
    return P.value_violations(panel(spark, d), ["hr_raw", "temp_raw"])


@query(f"SELECT stay_id, stay_time, gap FROM (SELECT stay_id, stay_time, stay_time - lag(stay_time) OVER ({_BY}) AS gap FROM concepts) WHERE gap < 1", CONCEPTS)
def order_violations(spark, d):
    return P.order_violations(concepts(spark, d))


_U1 = "CASE WHEN onset_position IS NULL THEN -0.05 WHEN k <= -6 THEN greatest((k + 12) / 6.0, -0.05) WHEN k <= 3 THEN (3 - k) / 9.0 ELSE 0.0 END"
_U0 = "CASE WHEN onset_position IS NULL THEN 0.0 WHEN k <= -6 THEN 0.0 WHEN k <= 3 THEN -2.0 * (k + 6) / 9.0 ELSE 0.0 END"
UTILITIES = ONSETS + f", kk AS (SELECT *, position - onset_position AS k FROM onsets), utilities AS (SELECT *, CAST({_U1} AS DOUBLE) AS u1, CAST({_U0} AS DOUBLE) AS u0 FROM kk)\n"


@query("SELECT stay_id, stay_time, round(u1, 6) AS u1, round(u0, 6) AS u0, round(u1 - u0, 6) AS utility FROM utilities", UTILITIES)
def utility_target(spark, d):
    return rounded(T.with_utilities(labelled(spark, d)).select("stay_id", "stay_time", "u1", "u0", "utility"))


@query(""", o AS (SELECT stay_id, stay_time, onset_delta AS d,
CASE WHEN onset_delta IS NULL OR onset_delta < -12 THEN -0.05 WHEN onset_delta <= -6 THEN (onset_delta + 12) / 6.0 WHEN onset_delta <= 3 THEN 1 - (onset_delta + 6) / 9.0 ELSE 0 END::DOUBLE AS pos,
CASE WHEN onset_delta IS NULL OR onset_delta <= -6 THEN 0 WHEN onset_delta <= 3 THEN -2 * (onset_delta + 6) / 9.0 ELSE 0 END::DOUBLE AS neg FROM onsets)
SELECT stay_id, stay_time, round(pos, 6) AS phys_pos, round(neg, 6) AS phys_neg, round(pos - neg, 6) AS phys_cum, round(greatest(pos, neg), 6) AS phys_opt,
CAST(coalesce(d BETWEEN -6 AND 6, false) AS INTEGER) AS class_inner, CAST(coalesce(d >= -6, false) AS INTEGER) AS class_open,
round(CASE WHEN d IS NULL OR d < -12 THEN -1.0 WHEN d < -8 THEN (d + 12) / 4.0 WHEN d = -8 THEN 1 WHEN d <= 6 THEN 1 - (d + 8) / 14.0 ELSE 0 END::DOUBLE, 6) AS ramp FROM o""", ONSETS)
def objectives(spark, d):
    t = F.col("onset_delta")
    return rounded(P.add_onset(labelled(spark, d)).select(
        "stay_id", "stay_time", *[c.alias(n) for n, c in T.objectives(t).items()], T.class_objective(t, -6, 6).alias("class_inner"), T.class_objective(t).alias("class_open"),
        T.ramp_objective(t, mid=-8, outside=-1.0).alias("ramp")))


@query("SELECT stay_id, round(avg(u1 - u0), 6) AS mean_utility FROM utilities GROUP BY stay_id", UTILITIES)
def mean_utility(spark, d):
    return rounded(T.with_utilities(labelled(spark, d)).groupBy("stay_id").agg(F.avg("utility").alias("mean_utility")))


_LAMBDA = UTILITIES + """, per AS (SELECT stay_id, max(CAST(is_case AS INTEGER)) AS c, count(*) AS n, max(onset_position) AS o, sum(greatest(u1, 0)) AS g, sum(u0) AS h FROM utilities GROUP BY stay_id),
sums AS (SELECT sum(CASE WHEN c = 1 THEN 0 ELSE n END) AS t_neg, sum(CASE WHEN c = 1 THEN greatest(o - 12, 0) ELSE 0 END) AS t_pos, sum(CASE WHEN c = 1 THEN g ELSE 0 END) AS g, sum(CASE WHEN c = 1 THEN h ELSE 0 END) AS h, avg(c) AS prevalence FROM per),
lam AS (SELECT 0.05 * t_neg / ((5 + 1) * (g - h) - 0.05 * t_pos) AS lam, prevalence FROM sums)
"""


@query("SELECT round(lam, 6) AS lam, round(prevalence, 6) AS prevalence FROM lam", _LAMBDA)
def lambda_weight(spark, d):
    return rounded(T.lambda_weight(labelled(spark, d), cost=5))


@query("SELECT stay_id, round(sum(CASE WHEN is_case THEN (u1 - u0) * lam ELSE u1 - u0 END), 5) AS target FROM utilities, lam GROUP BY stay_id", _LAMBDA)
def weighted_target(spark, d):
    lam = T.lambda_weight(labelled(spark, d), cost=5).first().lam
    out = T.with_utilities(labelled(spark, d))
    return out.groupBy("stay_id").agg(F.round(F.sum(T.weighted(F.col("utility"), F.col("is_case"), lam)), 5).alias("target"))


@query(", p AS (SELECT *, count(*) OVER (PARTITION BY stay_id) AS n, CAST(coalesce(temp_raw > 150, false) AS INTEGER) AS pred FROM utilities), "
       "s AS (SELECT CASE WHEN pred = 1 THEN u1 ELSE u0 END AS o, CASE WHEN onset_position IS NOT NULL AND position BETWEEN greatest(onset_position - 12, 0) AND least(onset_position + 3, n - 1) THEN u1 ELSE u0 END AS b, u0 AS i FROM p) "
       "SELECT round(sum(o), 4) AS observed, round(sum(b), 4) AS best, round(sum(i), 4) AS inaction, round((sum(o) - sum(i)) / (sum(b) - sum(i)), 6) AS normalised FROM s", UTILITIES)
def normalised_utility(spark, d):
    p = labelled(spark, d).withColumn("pred", F.coalesce(F.col("temp_raw") > 150, F.lit(False)).cast("int"))
    out = T.normalised_utility(p, "pred")
    return out.select(*[F.round(c, 6 if c == "normalised" else 4).alias(c) for c in out.columns])


@query("SELECT stay_id, stay_time FROM onsets WHERE stay_time >= 0 AND (hr_raw IS NOT NULL OR map_raw IS NOT NULL OR sbp_raw IS NOT NULL OR resp_raw IS NOT NULL OR temp_raw IS NOT NULL) AND sep3 IS NOT NULL", ONSETS)
def invalid_times_filter(spark, d):
    return C.observed_rows(C.in_stay_only(labelled(spark, d)), RAW).select("stay_id", "stay_time")


@query("SELECT stay_id, count(*) AS n_rows FROM onsets WHERE onset_position IS NULL OR (onset_position > 3 AND onset_position <= 168) GROUP BY stay_id", ONSETS)
def onset_bounds_filter(spark, d):
    return C.onset_bounds(P.add_onset(labelled(spark, d))).groupBy("stay_id").agg(F.count("*").alias("n_rows"))


@query("SELECT stay_id, count(*) AS n_rows FROM onsets WHERE CASE WHEN onset_position IS NOT NULL THEN position <= onset_position + 24 ELSE stay_time <= 192 END GROUP BY stay_id", ONSETS)
def case_truncation(spark, d):
    return C.truncate_cases(P.add_onset(labelled(spark, d))).groupBy("stay_id").agg(F.count("*").alias("n_rows"))


_STEPS = [("age", "age >= 14"), ("onset_in_stay", "onset IS NULL OR onset BETWEEN 0 AND outtime"), ("onset_bounds", "onset IS NULL OR onset BETWEEN 4 AND 168"), ("length", "outtime > 6")]


@query(", counted AS (SELECT count(*) AS s0, " + ", ".join(f"count(*) FILTER (WHERE {' AND '.join(f'coalesce({c}, false)' for _, c in _STEPS[: k + 1])}) AS s{k + 1}" for k in range(len(_STEPS))) + " FROM stays) "
       + " UNION ALL ".join(f"SELECT {k} AS step, '{n}' AS name, s{k} AS remaining FROM counted" for k, n in enumerate(["all"] + [n for n, _ in _STEPS])), STAYS)
def cohort_attrition(spark, d):
    return C.attrition(stays(spark, d), [(n, F.expr(c)) for n, c in _STEPS])


@query("SELECT stay_id, site FROM stays WHERE site IN (SELECT site FROM stays GROUP BY site HAVING avg(label) >= 0.15)", STAYS)
def site_prevalence_filter(spark, d):
    return C.prevalent_sites(stays(spark, d), "site", 0.15, "label").select("stay_id", "site")


@query(", s AS (SELECT site, count(*) AS n, CAST(sum(label) AS BIGINT) AS c FROM stays GROUP BY site) SELECT k / 20.0::DOUBLE AS threshold, CAST(sum(CASE WHEN c / n >= k / 20.0::DOUBLE THEN n ELSE 0 END) AS BIGINT) AS stays, "
       "CAST(sum(CASE WHEN c / n >= k / 20.0::DOUBLE THEN c ELSE 0 END) AS BIGINT) AS cases, count(*) FILTER (WHERE c / n >= k / 20.0::DOUBLE) AS sites FROM s, range(1, 7) t(k) GROUP BY k", STAYS)
def site_threshold_sweep(spark, d):
    return C.site_sweep(stays(spark, d), "site", [k / 20 for k in range(1, 7)], "label")


@query(", w AS (SELECT stay_id, CASE WHEN onset IS NOT NULL THEN onset + 24 ELSE least(outtime, 192) END AS cuttime FROM stays) SELECT p.stay_id, count(*) AS n_rows, max(stay_time) AS last_time FROM panel p JOIN w ON p.stay_id = w.stay_id AND p.stay_time <= w.cuttime WHERE p.stay_time >= -48 GROUP BY p.stay_id", STAYS)
def truncate_to_window(spark, d):
    w = stays(spark, d).withColumn("cuttime", C.cut_time(F.col("onset"), F.col("outtime")))
    return C.truncate_to_window(panel(spark, d), w).groupBy("stay_id").agg(F.count("*").alias("n_rows"), F.max("stay_time").alias("last_time"))


@query("SELECT stay_id FROM panel WHERE stay_time >= 0 AND coalesce(hr_raw, map_raw, sbp_raw, resp_raw, temp_raw) IS NOT NULL GROUP BY stay_id HAVING count(*) >= 60", PANEL)
def enough_measurements(spark, d):
    return C.enough_measurements(panel(spark, d), RAW, 60)


# orders are antibiotic-like, shipments sampling-like events of a customer, in days
_ABX = "abx AS (SELECT o_custkey AS stay_id, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS abx_time FROM orders), samp AS (SELECT DISTINCT o_custkey AS stay_id, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS samp_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey)\n"


def _abx(spark, d):
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86400).cast("long")
    o = table(spark, d, "orders")
    abx = o.select(F.col("o_custkey").alias("stay_id"), day("o_orderdate").alias("abx_time"))
    samp = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("stay_id"), day("l_shipdate").alias("samp_time")).distinct()
    return abx, samp


_SUSP = _ABX + ", susp AS (SELECT DISTINCT a.stay_id, abx_time, samp_time, least(abx_time, samp_time) AS si_time FROM abx a JOIN samp s ON a.stay_id = s.stay_id AND abx_time - samp_time BETWEEN -1 AND 3)\n"


@query("SELECT stay_id, abx_time, samp_time, si_time FROM susp", _SUSP)
def suspicion_window(spark, d):
    return C.suspicion(*_abx(spark, d), abx_after=3, sample_after=1)


@query("SELECT DISTINCT stay_id, abx_time, CAST(NULL AS BIGINT) AS samp_time, abx_time AS si_time FROM abx UNION SELECT DISTINCT stay_id, CAST(NULL AS BIGINT), samp_time, samp_time FROM samp", _ABX)
def suspicion_either(spark, d):
    return C.suspicion(*_abx(spark, d), mode="or")


@query("SELECT stay_id, abx_time, in_window FROM (SELECT *, count(*) OVER (PARTITION BY stay_id ORDER BY abx_time RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS in_window FROM abx) WHERE in_window >= 2", _ABX)
def repeated_treatments(spark, d):
    return C.abx_counts(_abx(spark, d)[0], hours=60, least=2)


@query(", scores AS (SELECT o_custkey AS stay_id, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS stay_time, min(o_orderkey % 9) AS sofa FROM orders GROUP BY ALL), inside AS (SELECT DISTINCT c.stay_id, si_time, stay_time, sofa FROM scores c JOIN susp s ON c.stay_id = s.stay_id AND stay_time BETWEEN si_time - 48 AND si_time + 24), "
       "delta AS (SELECT *, sofa - min(sofa) OVER (PARTITION BY stay_id, si_time ORDER BY stay_time ROWS UNBOUNDED PRECEDING) AS delta FROM inside), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY si_time, stay_time) AS rn FROM delta WHERE delta >= 2) SELECT stay_id, si_time, stay_time AS onset, delta FROM r WHERE rn = 1", _SUSP)
def interval_join_onset(spark, d):
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("long")
    scores = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("stay_id"), day.alias("stay_time")).agg(F.min(F.col("o_orderkey") % 9).alias("sofa"))
    return C.interval_onset(scores, C.suspicion(*_abx(spark, d), abx_after=3, sample_after=1))


@query(", a AS (SELECT DISTINCT stay_id, abx_time FROM abx) SELECT a.stay_id, a.abx_time, min(s.samp_time) AS next_time FROM a LEFT JOIN samp s ON a.stay_id = s.stay_id AND s.samp_time > a.abx_time GROUP BY ALL", _ABX)
def asof_next_event(spark, d):
    abx, samp = _abx(spark, d)
    return C.next_event(abx.distinct(), samp, "abx_time", "samp_time")


_CMP = _ABX + ", a AS (SELECT stay_id, min(abx_time) AS time_a FROM abx GROUP BY 1), b AS (SELECT stay_id, min(samp_time) AS time_b FROM samp GROUP BY 1), cmp AS (SELECT coalesce(a.stay_id, b.stay_id) AS stay_id, time_a, time_b, CASE WHEN time_b IS NULL THEN 'a' WHEN time_a IS NULL THEN 'b' ELSE 'both' END AS found_by, time_b - time_a AS difference FROM a FULL JOIN b ON a.stay_id = b.stay_id)\n"


@query("SELECT * FROM cmp", _CMP)
def definition_overlap(spark, d):
    abx, samp = _abx(spark, d)
    return C.compare_first(abx.withColumnRenamed("abx_time", "t"), samp.withColumnRenamed("samp_time", "t"), "t")


@query(", k AS (SELECT stay_id, abx_time + 2 AS onset, samp_time, abx_time FROM susp) SELECT cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, CAST(sum(known) AS BIGINT) AS sum_known FROM (SELECT CAST(samp_time <= onset AS INTEGER) + CAST(abx_time <= onset AS INTEGER) AS cls, greatest(onset, samp_time, abx_time) AS known FROM k) GROUP BY cls", _SUSP)
def time_class(spark, d):
    from pyspark.sql import Window

    k = C.suspicion(*_abx(spark, d), abx_after=3, sample_after=1).withColumn("onset", F.col("abx_time") + 2)
    cls = C.time_class(F.col("onset"), F.col("samp_time"), F.col("abx_time"))
    n = k.groupBy(cls.alias("cls")).agg(F.count("*").alias("n"), F.sum(C.known_time(F.col("onset"), F.col("samp_time"), F.col("abx_time"))).alias("sum_known"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6)).select("cls", "n", "share", "sum_known")


@query("SELECT stay_id, stay_time, " + ", ".join(f"round(avg(hr_locf) OVER ({_BY} ROWS {h - 1} PRECEDING) - avg(hr_locf) OVER ({_BY} ROWS BETWEEN {2 * h - 1} PRECEDING AND {h} PRECEDING), 6) AS hr_wavelet_{i}" for i, h in enumerate((16, 8, 4, 2, 1))) + " FROM filled", FILLED)
def haar_window(spark, d):
    out = W.haar(filled(spark, d), "hr_locf", "hr")
    return rounded(out.select("stay_id", "stay_time", *[f"hr_wavelet_{i}" for i in range(5)]))
