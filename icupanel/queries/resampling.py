"""Queries: bootstrap with replacement, tests with their tail probabilities, code maps, random utility, online scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from icupanel.operators import evaluate as E
from icupanel.operators import online
from icupanel.operators import panel as P
from icupanel.operators import splits as SP
from icupanel.operators import stats as ST
from icupanel.plans import models as M
from icupanel.queries.base import CONCEPTS, LABELLED, PANEL, PREDICTIONS, STAYS, concepts, filled, labelled, once, panel, predictions, query, rounded, stays, table
from icupanel.queries.evaluation import SPLITS, _h
from icupanel.queries.panels import _U0, _U1, UTILITIES

N_DRAWS = 20

#: Draws of the stays with replacement, stratified by label.
DRAWS = STAYS + f""", placed AS (SELECT label, stay_id, row_number() OVER (PARTITION BY label ORDER BY {_h(11)}, stay_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM stays),
picks AS (SELECT label, CAST(draw AS INTEGER) AS draw, {_h(12, "draw || '|' || r || '|' || label")} % n + 1 AS rank FROM placed, range({N_DRAWS}) d(draw)),
draws AS (SELECT p.label, draw, stay_id, count(*) AS times FROM picks JOIN placed p ON picks.label = p.label AND picks.rank = p.r GROUP BY ALL)
"""
_PEAKS = ", preds AS (SELECT stay_id, max(score) AS score, max(score2) AS score2 FROM (SELECT stay_id, coalesce(round(least(1.0, temp_locf / 300), 6), 0.0) AS score, coalesce(round(least(1.0, hr_locf / 300), 6), 0.0) AS score2 FROM (SELECT stay_id, last_value(temp_raw IGNORE NULLS) OVER w AS temp_locf, last_value(hr_raw IGNORE NULLS) OVER w AS hr_locf FROM labelled WINDOW w AS (PARTITION BY stay_id ORDER BY stay_time ROWS UNBOUNDED PRECEDING))) GROUP BY stay_id)\n"


def _peaks(spark, d):
    return predictions(spark, d).groupBy("stay_id").agg(F.max("score").alias("score"), F.max("score2").alias("score2"))


@query("SELECT label, draw, stay_id, times FROM draws", DRAWS)
def bootstrap_draws(spark, d):
    return SP.bootstrap_draws(stays(spark, d), N_DRAWS, by=("label",))


@query(", m AS (SELECT stay_id, count(hr_raw) AS n_hr, avg(hr_raw) AS hr FROM labelled GROUP BY stay_id) SELECT draw, CAST(sum(times) AS BIGINT) AS n, round(sum(times * n_hr) / sum(times), 6) AS n_hr, round(sum(times * hr) / sum(CASE WHEN hr IS NOT NULL THEN times END), 6) AS hr FROM draws JOIN m USING (stay_id) GROUP BY draw", DRAWS)
def bootstrap_means(spark, d):
    values = panel(spark, d).groupBy("stay_id").agg(F.count("hr_raw").alias("n_hr"), F.avg("hr_raw").alias("hr"))
    return rounded(SP.bootstrap_means(values, SP.bootstrap_draws(stays(spark, d), N_DRAWS, by=("label",)), ["n_hr", "hr"]))


@query(", m AS (SELECT draw, label, score, times FROM draws JOIN preds USING (stay_id)), a AS (SELECT p.draw, sum(p.times * q.times * CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / sum(p.times * q.times) AS auroc FROM m p JOIN m q ON p.draw = q.draw WHERE p.label = 1 AND q.label = 0 GROUP BY p.draw) "
       "SELECT round(avg(auroc), 6) AS mean, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.975), 6) AS high FROM a", DRAWS + _PEAKS)
def bootstrap_auroc_interval(spark, d):
    """Percentile interval of the area under ROC of stays' highest scores over draws with replacement."""
    draws = SP.bootstrap_draws(once(stays(spark, d), "stays"), N_DRAWS, by=("label",)).withColumnRenamed("stay_id", "_id")
    rows = once(draws.join(_peaks(spark, d), F.col("_id") == F.col("stay_id")), "drawn")
    areas = once(E.auroc_auprc(rows, by=["draw"], weight="times").select("draw", "auroc"), "areas")
    return rounded(ST.percentile_interval(areas, "auroc"))


@query(", u AS (SELECT draw || '_' || stay_id || '_' || copy AS unit_id, stay_id FROM (SELECT draw, stay_id, unnest(range(1, times + 1)) AS copy FROM draws)) SELECT unit_id, count(*) AS n_rows, round(sum(temp_raw), 6) AS sum_temp FROM u JOIN labelled USING (stay_id) GROUP BY unit_id", DRAWS)
def bootstrap_units(spark, d):
    """Panel rows of every unit drawn, under its own id."""
    units = SP.bootstrap_units(SP.bootstrap_draws(stays(spark, d), N_DRAWS, by=("label",)))
    return rounded(SP.bootstrap(panel(spark, d), units).groupBy("unit_id").agg(F.count("*").alias("n_rows"), F.sum("temp_raw").alias("sum_temp")))


#: Simpson's rule with 4,000 panels from 0 to x: two-sided tails of Student's t and the normal distribution.
_INTEGRAL = "1 - 2 * {x} / 12000 * (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f}) FROM range(4001) g(i))"
_P_T = _INTEGRAL.format(x="abs(t)", f="exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) - (df + 1) / 2 * ln(1 + pow(abs(t) * i / 4000, 2) / df))")
_P_Z = _INTEGRAL.format(x="least(abs(z), 12)", f="exp(-pow(least(abs(z), 12) * i / 4000, 2) / 2) / sqrt(2 * pi())")


@query(f""", d AS (SELECT site, score - score2 AS d FROM preds JOIN stays USING (stay_id)),
t AS (SELECT site, count(*) AS n, avg(d) AS mean_difference, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t, count(*) - 1.0::DOUBLE AS df FROM d GROUP BY site),
ranked AS (SELECT site, d > 0 AS up, rank() OVER (PARTITION BY site ORDER BY abs(d)) + (count(*) OVER (PARTITION BY site, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY site, abs(d)) AS k FROM d WHERE d <> 0),
w AS (SELECT site, count(*) AS m, sum(CASE WHEN up THEN r ELSE 0 END)::DOUBLE AS w, sum(k * k - 1)::DOUBLE AS ties FROM ranked GROUP BY site),
ways AS (SELECT 0 AS n, 0 AS s, 1.0::DOUBLE AS c UNION ALL SELECT n + 1, s + a * (n + 1), sum(c) FROM ways, range(2) g(a) WHERE n < 50 GROUP BY n, s + a * (n + 1)),
z AS (SELECT *, (w - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - ties / 48) AS z FROM w)
SELECT site, n, round(mean_difference, 6) AS mean_difference, round(t, 4) AS t, round({_P_T}, 5) AS p_t, coalesce(m, 0) AS m, coalesce(w, 0) AS w,
round(CASE WHEN m IS NULL THEN NULL WHEN ties = 0 AND m <= 50 THEN least(1, 2 * (SELECT sum(c) FROM ways WHERE ways.n = m AND s <= least(w, m * (m + 1) / 2.0 - w)) / pow(2, m)) ELSE {_P_Z} END, 5) AS p_w FROM t LEFT JOIN z USING (site)""", "RECURSIVE " + STAYS + _PEAKS)
def paired_tests_by_site(spark, d):
    """Two scores' highest values of each stay compared within sites: paired t and signed ranks with their probabilities."""
    met = _peaks(spark, d).join(stays(spark, d).select(F.col("stay_id").alias("_id"), "site"), F.col("stay_id") == F.col("_id"))
    t = ST.paired_tests_by(met, "score", "score2", ["site"])
    return t.select("site", "n", F.round("mean_difference", 6).alias("mean_difference"), F.round("t", 4).alias("t"), F.round("p_t", 5).alias("p_t"), "m", "w", F.round("p_w", 5).alias("p_w"))


@query(""", f AS (SELECT stay_id, concept, min_by(value, (stay_time, value)) AS value FROM concepts GROUP BY ALL),
v AS (SELECT concept, value, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS a, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS b FROM f JOIN customer ON stay_id = c_custkey GROUP BY ALL),
s AS (SELECT concept, a, b, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS d FROM v WINDOW p AS (PARTITION BY concept), w AS (PARTITION BY concept ORDER BY value ROWS UNBOUNDED PRECEDING)),
k AS (SELECT concept, max(d) AS statistic, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM s GROUP BY concept)
SELECT concept, round(statistic, 6) AS statistic, n_a, n_b, round((SELECT sum(CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * i * i * statistic * statistic * n_a * n_b / (n_a + n_b))) FROM range(1, 2001) g(i)), 5) AS p FROM k""", CONCEPTS)
def ks_first_values(spark, d):
    """First values of each concept, stays of one segment against all others."""
    segment = table(spark, d, "customer").select(F.col("c_custkey").alias("_c"), (F.col("c_mktsegment") == "BUILDING").alias("inside"))
    first = ST.first_values(concepts(spark, d), "value", ["concept"]).join(segment, F.col("stay_id") == F.col("_c"))
    t = ST.ks_tests(first, "inside", "value", ["concept"])
    return t.select("concept", F.round("statistic", 6).alias("statistic"), "n_a", "n_b", F.round("p", 5).alias("p"))


#: Part types in groups by overlapping prefixes, as diagnosis codes are.
CODE_MAP = [("S", "other s"), ("STANDARD", "standard"), ("STANDARD POLISHED", "polished"), ("PROMO", "promo"), ("PROMO BURNISHED C", "burnished"), ("ECON", "economy"), ("ECON", "zz"), ("", "never")]
_MAP = "mapping(prefix, grp) AS (VALUES " + ", ".join(f"('{p}', '{g}')" for p, g in CODE_MAP) + """),
mapped AS (SELECT p_partkey, p_size, p_type, (SELECT min_by(grp, (-length(prefix), grp)) FROM mapping WHERE prefix <> '' AND starts_with(trim(split_part(p_type, ',', 1)), prefix)) AS grp FROM part)
"""


def _mapped(spark, d):
    mapping = spark.createDataFrame(CODE_MAP, "prefix string, group string")
    return table(spark, d, "part").select("p_partkey", F.col("p_size").alias("stay_id"), "p_type"), mapping


@query("SELECT p_partkey, p_type, grp AS \"group\" FROM mapped", _MAP)
def code_map(spark, d):
    codes, mapping = _mapped(spark, d)
    return ST.mapped_codes(codes, "p_type", mapping).select("p_partkey", "p_type", "group")


@query("SELECT p_size AS stay_id, " + ", ".join(f"max(CAST(coalesce(grp = '{g}', false) AS INTEGER)) AS {g}" for g in ("standard", "polished", "economy")) + " FROM mapped GROUP BY p_size", _MAP)
def code_map_flags(spark, d):
    codes, mapping = _mapped(spark, d)
    return ST.group_flags(codes, "p_type", mapping, ["standard", "polished", "economy"])


@query(f""", c AS (SELECT u1, u0, CASE WHEN onset_position IS NOT NULL AND position BETWEEN greatest(onset_position - 12, 0) AND least(onset_position + 3, count(*) OVER (PARTITION BY stay_id) - 1) THEN u1 ELSE u0 END AS best, CAST(draw AS INTEGER) AS draw,
{_h('draw', "stay_id || '_' || stay_time")}::DOUBLE / 4503599627370496.0::DOUBLE AS coin FROM utilities, range(5) t(draw)),
s AS (SELECT p, draw, count(*) FILTER (WHERE coin < p) AS alarms, sum(CASE WHEN coin < p THEN u1 ELSE u0 END) AS observed, sum(best) AS best, sum(u0) AS inaction FROM c, (SELECT CAST(k / 20.0 AS DOUBLE) AS p FROM range(21) g(k)) GROUP BY p, draw)
SELECT p, draw, alarms, round(observed, 4) AS observed, round((observed - inaction) / (best - inaction), 6) AS normalised FROM s""", UTILITIES)
def random_utility(spark, d):
    out = M.random_utility(labelled(spark, d), [k / 20 for k in range(21)], 5)
    return out.select("p", "draw", "alarms", F.round("observed", 4).alias("observed"), F.round("normalised", 6).alias("normalised"))


_ONLINE = f""", seen AS (SELECT stay_id, stay_time, label, CAST(score >= 0.5 AS INTEGER)::DOUBLE AS pred FROM (SELECT p.*, hr_raw, temp_raw FROM predictions p JOIN filled f USING (stay_id, stay_time)) WHERE hr_raw IS NOT NULL OR temp_raw IS NOT NULL),
ends AS (SELECT stay_id, min(stay_time) AS lo, max(stay_time) AS hi, min(CASE WHEN label = 1 THEN stay_time END) AS o FROM seen GROUP BY stay_id),
hours AS (SELECT stay_id, o, unnest(range(lo, hi + 1)) AS stay_time FROM ends),
shifted AS (SELECT stay_id, stay_time, pred, CASE WHEN label IS NULL THEN NULL WHEN o IS NULL THEN label WHEN stay_time BETWEEN o - 6 AND o + 24 THEN 1 ELSE 0 END AS y FROM hours LEFT JOIN seen USING (stay_id, stay_time)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY stay_time) - 1 AS position, count(*) OVER (PARTITION BY stay_id) AS n FROM shifted),
cases AS (SELECT *, min(CASE WHEN y = 1 THEN position END) OVER (PARTITION BY stay_id) AS onset_position FROM numbered),
kk AS (SELECT *, position - onset_position AS k FROM cases),
valued AS (SELECT *, CAST({_U1} AS DOUBLE) AS u1, CAST({_U0} AS DOUBLE) AS u0 FROM kk WHERE pred IS NOT NULL),
sums AS (SELECT sum(CASE WHEN pred = 1 THEN u1 ELSE u0 END) AS observed, sum(CASE WHEN onset_position IS NOT NULL AND position BETWEEN greatest(onset_position - 12, 0) AND least(onset_position + 3, n - 1) THEN u1 ELSE u0 END) AS best, sum(u0) AS inaction FROM valued)
"""


@query("SELECT round(observed, 4) AS observed, round(best, 4) AS best, round(inaction, 4) AS inaction, round((observed - inaction) / (best - inaction), 6) AS normalised FROM sums", PREDICTIONS + _ONLINE)
def online_utility(spark, d):
    """Utility of alarms in measured hours only: gaps are filled with nulls, labels moved six hours forward."""
    seen = predictions(spark, d, ("hr_raw", "temp_raw")).where("hr_raw IS NOT NULL OR temp_raw IS NOT NULL")
    out = online.online_score(seen.select("stay_id", "stay_time", "label"), seen.select("stay_id", "stay_time", (F.col("score") >= 0.5).cast("int").alias("prediction")), shift_left=6)
    return out.select(*[F.round(c, 6 if c == "normalised" else 4).alias(c) for c in out.columns])


_LONG = ", long AS (SELECT rep, split, variable, v FROM (SELECT rep, split, hr_raw, temp_raw FROM splits JOIN panel USING (stay_id)) UNPIVOT INCLUDE NULLS (v FOR variable IN (hr_raw, temp_raw)))\n"


@query("SELECT rep, split, variable, count(v) AS n, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for n, q in (("q01", 0.01), ("median", 0.5), ("q99", 0.99))) + " FROM long GROUP BY ALL", SPLITS + _LONG)
def split_quantiles(spark, d):
    return rounded(ST.split_quantiles(panel(spark, d), SP.stratified_split(stays(spark, d)), ["hr_raw", "temp_raw"], {"q01": 0.01, "median": 0.5, "q99": 0.99}))


@query(", ends AS (SELECT variable, min(v) AS lo, max(v) AS hi FROM (SELECT hr_raw, temp_raw FROM panel) UNPIVOT (v FOR variable IN (hr_raw, temp_raw)) GROUP BY 1), b AS (SELECT rep, split, variable, lo, hi, CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin FROM long JOIN ends USING (variable) WHERE v IS NOT NULL) "
       "SELECT rep, split, variable, bin, round(lo + bin * (hi - lo) / 10, 6) AS low, round(lo + (bin + 1) * (hi - lo) / 10, 6) AS high, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY rep, split, variable), 6) AS share FROM b GROUP BY rep, split, variable, bin, lo, hi", SPLITS + _LONG)
def split_histograms(spark, d):
    return rounded(ST.split_histograms(panel(spark, d), SP.stratified_split(stays(spark, d)), ["hr_raw", "temp_raw"]))


@query(f", t AS (SELECT stay_id, label, row_number() OVER (PARTITION BY label ORDER BY {_h(4)}, stay_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM splits WHERE rep = 0 AND split = 'train') SELECT stay_id, label, size FROM t, (VALUES (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE)) v(size) WHERE r <= ceil(round(n * size / 0.8::DOUBLE, 9))", SPLITS)
def training_subsets(spark, d):
    return SP.training_subsets(SP.stratified_split(stays(spark, d)))


@query(f", t AS (SELECT stay_id, label, rep, row_number() OVER (PARTITION BY label, rep ORDER BY {_h('rep + 6')}, stay_id) AS r, count(*) OVER (PARTITION BY label, rep) AS n FROM splits WHERE split = 'validation') SELECT stay_id, label, rep, share, CASE WHEN r <= floor(round(n * share, 9)) THEN 'train' ELSE 'validation' END AS split FROM t, (VALUES (0.9::DOUBLE), (0.7::DOUBLE)) v(share)", SPLITS)
def validation_resplit(spark, d):
    return SP.resplit(SP.stratified_split(stays(spark, d)))


_BANDS = """, pts AS (SELECT rep, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS x, avg(predictions.label) AS y FROM predictions JOIN splits USING (stay_id) WHERE split = 'train' GROUP BY 1, 2),
points_at AS (SELECT rep, CAST(k AS INTEGER) AS grid_no, k / 9.0::DOUBLE AS pos FROM (SELECT DISTINCT rep FROM pts), range(10) g(k)),
ends AS (SELECT rep, grid_no, pos, coalesce(max_by({x: x, y: y}, x) FILTER (WHERE x <= pos), min_by({x: x, y: y}, x)) AS lo, coalesce(min_by({x: x, y: y}, x) FILTER (WHERE x >= pos), max_by({x: x, y: y}, x)) AS hi, coalesce(sum(n) FILTER (WHERE bin = grid_no), 0) AS n FROM points_at JOIN pts USING (rep) GROUP BY ALL),
vals AS (SELECT grid_no, pos, n, CASE WHEN hi.x > lo.x THEN lo.y + (pos - lo.x) / (hi.x - lo.x) * (hi.y - lo.y) ELSE lo.y END AS y FROM ends)
"""


@query("SELECT grid_no, round(pos, 6) AS x, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, round(avg(n), 6) AS n_mean, round(stddev_pop(n), 6) AS n_std FROM vals GROUP BY grid_no, pos",
       "".join([PREDICTIONS, ", ", SPLITS[len(LABELLED):].lstrip().removeprefix(","), _BANDS]))
def calibration_bands(spark, d):
    """Reliability of a score over the repetitions' training stays: mean and deviation at even points."""
    parts = SP.stratified_split(stays(spark, d)).where("split = 'train'").select(F.col("stay_id").alias("_id"), "rep")
    rows = predictions(spark, d).join(parts.hint("shuffle_hash"), F.col("stay_id") == F.col("_id"))
    return rounded(E.calibration_bands(rows))


@query("SELECT stay_id, CAST(count(*) AS INTEGER) AS length, md5(string_agg(stay_time || ':' || coalesce(CAST(CAST(round(hr_raw * 1000) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY stay_time) || repeat(',-:-9000', CAST(greatest(800 - count(*), 0) AS INTEGER))) AS digest FROM panel GROUP BY stay_id", PANEL)
def instance_digest(spark, d):
    """The padded arrays themselves: every time and value in order, then the padding."""
    out = P.instances(panel(spark, d), ["hr_raw"], length=800, pad=-9.0)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    each = F.transform(F.arrays_zip("stay_times", "hr_raw"), lambda r: F.concat(text(r["stay_times"]), F.lit(":"), text(F.round(r["hr_raw"] * 1000).cast("long"))))
    return out.select("stay_id", "length", F.md5(F.array_join(each, ",")).alias("digest"))
