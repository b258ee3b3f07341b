"""Queries: column sets, recodes, sources and sinks, models, signatures, streams."""

from __future__ import annotations

import math
from itertools import product

import pandas as pd
from pyspark.sql import functions as F

from icupanel import schema
from icupanel.functions import scores as S
from icupanel.functions import targets as T
from icupanel.functions import windows as W
from icupanel.operators import cohort as C
from icupanel.operators import evaluate as E
from icupanel.operators import panel as P
from icupanel.operators import splits as SP
from icupanel.operators import stats as ST
from icupanel.plans import fitted
from icupanel.plans import models as M
from icupanel.queries.base import FILLED, LOCF, NAMES, PANEL, PREDICTIONS, RAW, STAYS, filled, labelled, panel, once, predictions, query, rounded, scratch, stays, table
from icupanel.queries.evaluation import SPLITS
from icupanel.queries.panels import _LAMBDA
from icupanel.sources import io
from icupanel.streaming import alarms


@query("SELECT stay_id, stay_time, round(hr_raw, 6) AS hr_raw, round(map_raw, 6) AS map_raw, round(resp_raw, 6) AS resp_raw FROM panel", PANEL)
def feature_group_select(spark, d):
    p = panel(spark, d)
    chosen = schema.challenge_set(schema.feature_set(p.columns, "raw_vitals"))
    return rounded(p.select(*[c for c in chosen if c not in ("sbp_raw", "temp_raw")]))


@query("SELECT stay_id, stay_time, round(sbp_raw, 6) AS sbp, round(temp_raw, 6) AS temp FROM panel", PANEL)
def drop_and_strip(spark, d):
    p = schema.drop_suffix(filled(spark, d).drop("sep3"), "_locf")
    p = p.drop(*[c for c in schema.matching(p.columns, "^(hr|map|resp)_") if c.endswith("_raw")])
    return rounded(schema.strip_suffixes(p))


@query("SELECT stay_id, stay_time, round(hr_raw, 6) AS hr_raw FROM panel", PANEL)
def drop_missing_vars(spark, d):
    p = panel(spark, d).select("stay_id", "stay_time", "hr_raw").withColumn("lact_raw", F.lit(None).cast("double")).withColumn("lact_count", F.lit(0))
    return rounded(schema.drop_all_missing(p))


@query("SELECT stay_id, round(max(hr_raw), 6) AS top FROM panel GROUP BY stay_id", PANEL)
def keep_first_columns(spark, d):
    p = schema.keep_first(labelled(spark, d), 1)
    return rounded(p.groupBy("stay_id").agg(F.max("hr_raw").alias("top")))


@query("SELECT stay_id, " + ", ".join(f"CAST(coalesce(segment = '{s}', false) AS INTEGER) AS \"segment_{s}\"" for s in ("BUILDING", "AUTOMOBILE", "MACHINERY")) + " FROM stays", STAYS)
def one_hot_levels(spark, d):
    return schema.one_hot(stays(spark, d).select("stay_id", "segment"), "segment", ["BUILDING", "AUTOMOBILE", "MACHINERY", "Other"])


@query("SELECT stay_id, stay_time, CASE WHEN temp_raw > 100 THEN 1.0 WHEN temp_raw <= 100 THEN 0.0 END::DOUBLE AS warm FROM panel", PANEL)
def bool_to_float(spark, d):
    return schema.bool_to_float(panel(spark, d).select("stay_id", "stay_time", (F.col("temp_raw") > 100).alias("warm")))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def where_equal(spark, d):
    """Rows of one segment: the filter by key and value is the feature."""
    return schema.where_equal(table(spark, d, "customer"), {"c_mktsegment": "BUILDING"}).select("c_custkey", "c_nationkey", "c_acctbal")


@query("SELECT stay_id, stay_time, round(CASE WHEN n = 0 THEN NULL ELSE s / n END, 6) AS mean, coalesce(hr_raw > 100, false) AS fast, round(1 / (1 + exp(-coalesce(hr_raw, 0) / 100)), 6) AS sig, least(greatest(coalesce(hr_raw, 0) / 100 - 1, 0), 1) AS clipped, round((temp_locf - 2) / 24, 6) AS prob "
       "FROM (SELECT *, coalesce(hr_raw, 0) + coalesce(map_raw, 0) AS s, CAST(hr_raw IS NOT NULL AS INTEGER) + CAST(map_raw IS NOT NULL AS INTEGER) AS n FROM filled)", FILLED)
def scalar_functions(spark, d):
    hr = F.coalesce(F.col("hr_raw"), F.lit(0.0))
    return rounded(filled(spark, d).select(
        "stay_id", "stay_time", S.row_mean([F.col("hr_raw"), F.col("map_raw")]).alias("mean"), S.is_true(F.col("hr_raw") > 100).alias("fast"), S.sigmoid(hr / 100).alias("sig"),
        S.clip01(hr / 100 - 1).alias("clipped"), S.baseline_probability(F.col("temp_locf"), 2, 24).alias("prob")))


@query("SELECT c_custkey AS stay_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS grp, CAST(c_nationkey AS VARCHAR) || '_x_' || c_custkey AS code, 'x' AS part1, CAST(NULL AS VARCHAR) AS part5, regexp_replace(c_name, '#0*', ' ') AS label FROM customer")
def recodes(spark, d):
    c = table(spark, d, "customer").withColumn("code", F.concat_ws("_", F.col("c_nationkey").cast("string"), F.lit("x"), F.col("c_custkey").cast("string")))
    return c.select(F.col("c_custkey").alias("stay_id"), S.recode(F.col("c_mktsegment"), {"BUILDING": "b", "MACHINERY": "m"}, "other").alias("grp"), "code",
                    S.parameter(F.col("code"), 1).alias("part1"), S.parameter(F.col("code"), 5).alias("part5"), F.regexp_replace("c_name", "#0*", " ").alias("label"))


@query(", a AS (SELECT stay_id, list(temp_raw ORDER BY stay_time) AS v FROM panel GROUP BY stay_id) SELECT stay_id, CAST(len(v) AS INTEGER) AS n, CASE WHEN list_max(v) IS NULL THEN NULL ELSE list_max(v) > 0 END AS any_above, CASE WHEN list_max(v) IS NULL THEN NULL ELSE CAST(list_position(v, list_max(v)) - 1 AS BIGINT) END AS top_at FROM a", PANEL)
def array_functions(spark, d):
    a = P.instances(panel(spark, d), ["temp_raw"])
    return a.select("stay_id", F.size("temp_raw").alias("n"), S.any_of(F.col("temp_raw")).alias("any_above"), S.arg_max(F.col("temp_raw")).alias("top_at"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_access(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT c_custkey AS id, 'customer' AS source, c_acctbal AS balance, CAST(NULL AS DOUBLE) AS price FROM customer UNION ALL SELECT o_orderkey, 'orders', NULL, o_totalprice FROM orders")
def union_sources(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return io.union_sources({"customer": c, "orders": o})


@query("SELECT event_type AS model, stay_id, stay_time, label, score FROM predictions, (SELECT DISTINCT event_type FROM events WHERE event_type IN ('view', 'click')) e", PREDICTIONS)
def prediction_documents(spark, d):
    """Prediction documents written as JSON and read back as rows."""
    rows = predictions(spark, d).withColumn("model", F.explode(F.array(F.lit("view"), F.lit("click")))).select("model", "stay_id", "stay_time", "label", "score")
    path = scratch(spark, "documents")
    io.write_json(io.to_documents(rows, ["model"]), path)
    return io.read_documents(spark, path, {"model": "string"}, whole_files=False).withColumn("stay_time", F.col("stay_time").cast("long"))


@query("SELECT stay_id, stay_time, round(hr_raw, 6) AS hr_raw FROM panel", PANEL)
def psv_files(spark, d):
    """Pipe-separated files, a stay each, written and read back."""
    path = scratch(spark, "psv")
    io.write_psv(panel(spark, d), path, ["hr_raw"])
    return rounded(io.read_psv(spark, path, "stay_time long, hr_raw double", r"stay_id=(\d+)/").select("stay_id", "stay_time", "hr_raw"))


@query("SELECT stay_id, stay_time, round(temp_raw, 6) AS temp_raw FROM panel WHERE stay_id IN (1, 5, 7) AND stay_time >= 10", PANEL)
def panel_file_scan(spark, d):
    """A panel written sorted by stay, of which three stays are read by pushed-down ids."""
    path = scratch(spark, "panel")
    io.write_panel(panel(spark, d), path)
    return rounded(io.load(spark, path, [1, 5, 7], "stay_time >= 10", ["stay_id", "stay_time", "temp_raw"]))


@query("SELECT stay_id, stay_time, round(temp_raw, 6) AS temp_raw FROM panel", PANEL)
def panel_columns(spark, d):
    """A panel written and read back by its columns."""
    path = scratch(spark, "columns")
    io.write_panel(panel(spark, d), path)
    return rounded(io.read_panel(spark, path, ["stay_id", "stay_time", "temp_raw"]))


@query("SELECT stay_id, stay_time, round(hr_raw, 6) AS hr_raw FROM panel WHERE stay_id = 3", PANEL)
def one_stay(spark, d):
    """Random access to one stay of a written panel: the lookup is the feature."""
    path = scratch(spark, "stay")
    io.write_panel(panel(spark, d), path)
    return rounded(io.one_stay(spark, path, 3).select("stay_id", "stay_time", "hr_raw"))


@query("SELECT 'hr_raw' AS \"column\", round(avg(hr_raw), 6) AS mean, round(stddev_samp(hr_raw), 6) AS std FROM panel UNION ALL SELECT 'temp_raw', round(avg(temp_raw), 6), round(stddev_samp(temp_raw), 6) FROM panel", PANEL)
def normaliser_file(spark, d):
    """Means and deviations written as JSON and read back."""
    path = scratch(spark, "normaliser")
    io.write_normaliser(ST.normaliser(panel(spark, d), ["hr_raw", "temp_raw"]), path)
    return rounded(io.read_normaliser(spark, path))


@query("SELECT c_nationkey AS site, round(avg(floor(c_acctbal)) / 1024, 6) AS \"lambda\" FROM customer GROUP BY 1")
def weight_file(spark, d):
    """Weights by site written as JSON and read back."""
    path = scratch(spark, "weights")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("site")).agg((F.avg(F.floor("c_acctbal")) / 1024).alias("lambda"))
    io.write_weights(c, path, ["site"])
    return rounded(io.read_weights(spark, path, {"site": "long"}))


@query("SELECT 'train' AS split, round(lam, 6) AS \"lambda\" FROM lam", _LAMBDA)
def lambda_file(spark, d):
    """The prevalence weight written as JSON and read back."""
    path = scratch(spark, "lambda")
    io.write_weights(T.lambda_weight(labelled(spark, d), cost=5).select(F.lit("train").alias("split"), F.col("lam").alias("lambda")), path, ["split"])
    return rounded(io.read_weights(spark, path, {"split": "string"}))


@query("SELECT stay_id, label, rep, split FROM splits", SPLITS)
def split_file(spark, d):
    """Splits written as JSON lines and read back."""
    path = scratch(spark, "split-file")
    io.write_splits(SP.stratified_split(stays(spark, d)), path)
    return io.read_split_rows(spark, path)


@query("SELECT 'view' AS model, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS share FROM predictions GROUP BY 2", PREDICTIONS)
def evaluation_file(spark, d):
    """A calibration table written under its run and read back."""
    path = scratch(spark, "evaluation")
    io.write_evaluation(rounded(E.calibration(predictions(spark, d))), path, {"model": "view"})
    return io.read_evaluation(spark, path, "model string, bin int, n long, mean_score double, share double")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, count(*) - count({c}) AS missing, round(1 - count({c}) / count(*), 6) AS share FROM panel" for c in RAW), PANEL)
def statistics_file(spark, d):
    """Column statistics written as JSON and read back."""
    p, path = once(panel(spark, d), "panel"), scratch(spark, "statistics")
    io.write_statistics(ST.normaliser(p, RAW).join(ST.missing_report(p, RAW), "column"), path)
    return rounded(io.read_statistics(spark, path))


@query("SELECT n_nationkey, n_name FROM nation")
def source_registry(spark, d):
    """Two versions of a source in one folder: the newest is found by its number and read."""
    folder, nation = scratch(spark, "sources"), table(spark, d, "nation").select("n_nationkey", "n_name")
    nation.where("n_nationkey % 2 = 0").write.parquet(f"{folder}/demo_1.9.0")
    nation.write.parquet(f"{folder}/demo_1.10.0")
    nation.limit(1).write.parquet(f"{folder}/other_2.parquet")
    return io.open_source(spark, folder, "demo")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{schema.base_name(c)}' AS variable, '{schema.category(schema.base_name(c))}' AS category, '{schema.column_group(c)}' AS kind, count({c}) AS n FROM filled" for c in [*RAW, *LOCF]), FILLED)
def variable_mapping(spark, d):
    """Each panel column's variable, category and kind, and its number of values."""
    columns = [*RAW, *LOCF]
    names = spark.createDataFrame([(c, schema.base_name(c), schema.category(schema.base_name(c)), schema.column_group(c)) for c in columns], "column string, variable string, category string, kind string")
    n = filled(spark, d).agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "column", "n")
    return names.join(n, "column")


@query("SELECT stay_id, stay_time, round(temp_raw, 6) AS temp_raw FROM panel", PANEL)
def drop_categories(spark, d):
    """A panel without its raw vitals but one: those of a category go, others stay."""
    p = panel(spark, d)
    kept = schema.drop_categories([c for c in p.columns if c != "temp_raw"], ["vitals"])
    return rounded(p.select(*kept, "temp_raw"))


@query("SELECT rep, split, count(*) AS n FROM splits GROUP BY ALL", SPLITS)
def split_cache(spark, d):
    """Splits written partitioned and read back."""
    path = scratch(spark, "splits")
    io.write_split_cache(SP.stratified_split(stays(spark, d)), path)
    return spark.read.parquet(path).groupBy("rep", "split").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS site, count(*) AS n, round(avg(floor(c_acctbal)), 6) AS mean FROM customer GROUP BY 1")
def result_csv(spark, d):
    path = scratch(spark, "csv")
    io.write_csv(rounded(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("site")).agg(F.count("*").alias("n"), F.avg(F.floor("c_acctbal")).alias("mean"))), path)
    return io.read_csv(spark, path, "site int, n long, mean double")


@query("SELECT c_mktsegment AS run, unnest(['test', 'train', 'train']) AS split, unnest(['n', 'n', 'best']) AS metric, unnest([count(*) FILTER (WHERE c_custkey % 5 = 0), count(*) FILTER (WHERE c_custkey % 5 <> 0), max(floor(c_acctbal)) FILTER (WHERE c_custkey % 5 <> 0)])::DOUBLE AS value FROM customer GROUP BY 1")
def gather_runs(spark, d):
    runs = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("run")).agg(
        F.struct(F.count_if(F.col("c_custkey") % 5 != 0).alias("n"), F.max(F.when(F.col("c_custkey") % 5 != 0, F.floor("c_acctbal"))).alias("best")).alias("train"), F.struct(F.count_if(F.col("c_custkey") % 5 == 0).alias("n")).alias("test"))
    return io.flatten_runs(runs, ["run"], ["train", "test"])


@query("SELECT c_mktsegment AS model, 1 AS n_files FROM customer GROUP BY 1")
def result_index(spark, d):
    path = scratch(spark, "results")
    io.write_json(table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.count("*").alias("n")).repartition(1), path)
    return io.index_results(spark, path, ["model"], whole_files=False).select("model", F.size("files").alias("n_files"))


@query("SELECT stay_id, count(*) AS n, round(sum(hr_raw), 6) AS s FROM panel GROUP BY stay_id", PANEL)
def per_patient_function(spark, d):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stay_id": [pdf["stay_id"].iloc[0]], "n": [len(pdf)], "s": [pdf["hr_raw"].sum(min_count=1)]})

    return rounded(M.per_patient(panel(spark, d).select("stay_id", "hr_raw"), f, "stay_id long, n long, s double"))


@query(", l AS (SELECT stay_id, stay_time, hr_locf FROM filled WHERE stay_time >= 0) SELECT stay_id, stay_time, round(hr_locf, 6) AS hr_locf FROM l WHERE hr_locf IS NOT NULL", FILLED)
def pipeline_steps(spark, d):
    steps = [("locf", lambda x: W.locf(x, RAW)), ("in stay", C.in_stay_only), ("columns", lambda x: x.select("stay_id", "stay_time", "hr_locf")), ("observed", lambda x: x.where("hr_locf is not null"))]
    return rounded(M.chain(labelled(spark, d), steps))


def _signature_sql(rows: int = 7) -> str:
    """All 14 values from the increments a to f of both columns: sums over non-falling steps, equal ones divided by the factorial of their number."""
    steps = range(1, rows)
    value = {0: "coalesce(hr_locf, 0)", 1: "coalesce(temp_locf, 0)"}
    ago = lambda i, k: f"coalesce(lag({value[i]}, {k}) OVER w, 0)" if k else value[i]
    d = ", ".join(f"{ago(i, rows - 1 - k)} - {ago(i, rows - k)} AS d{k}{i}" for i in value for k in steps)
    out = []
    for n in (1, 2, 3):
        for word in product((0, 1), repeat=n):
            terms = [f"{'*'.join(f'd{k}{i}' for k, i in zip(at, word))}/{math.prod(math.factorial(at.count(k)) for k in set(at))}.0" for at in product(steps, repeat=n) if list(at) == sorted(at)]
            out.append(f"round({' + '.join(terms)}, 4) AS s{len(out)}")
    return f", x AS (SELECT stay_id, stay_time, {d} FROM filled WINDOW w AS (PARTITION BY stay_id ORDER BY stay_time)) SELECT stay_id, stay_time, {', '.join(out)} FROM x"


@query(_signature_sql(), FILLED)
def path_signature(spark, d):
    """All values of the signatures of two columns over the look-back."""
    sig = M.path_signatures(filled(spark, d), ["hr_locf", "temp_locf"])
    return sig.select("stay_id", "stay_time", *[F.round(f"signature_signature_{k}", 4).alias(f"s{k}") for k in range(14)])


def _model_rows(spark, d):
    folds = SP.folds(stays(spark, d), 3).select(F.col("stay_id").alias("_id"), "fold")
    rows = filled(spark, d).withColumnRenamed("sep3", "label").join(folds.hint("shuffle_hash"), F.col("stay_id") == F.col("_id")).drop("_id")
    return rows.select("stay_id", "stay_time", "label", "fold", "hr_locf", "map_locf", "temp_locf")


_FEATURES = ["hr_locf", "map_locf", "temp_locf"]


@query()
def logistic_cv(spark, d):
    """Cross-validated logistic regression: one row a grid point with its mean area under ROC."""
    rows = once(M.counted(_model_rows(spark, d), _FEATURES, ["label", "fold"]), "counted-rows")
    cv = M.search(rows, "logistic", _FEATURES, {"regParam": [0.0, 0.1], "maxIter": [5]}, "fold", weight="weight")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(cv.avgMetrics)], "point int, auroc double")


@query()
def search_refit(spark, d):
    """A random search by folds, and its best point fitted anew on every repetition of the splits."""
    rows, grid = once(_model_rows(spark, d), "model-rows"), {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5], "maxIter": [5]}
    points = M.grid_points(grid, 3)
    best = M.best_point(M.search(rows, "logistic", _FEATURES, grid, "fold", n=3), points)
    return spark.createDataFrame(M.refit(rows, once(SP.stratified_split(stays(spark, d), reps=3), "splits"), "logistic", _FEATURES, best, kept=lambda df: once(df, "refit-rows")), "rep int, validation double, test double")


_FIT = SPLITS + """, part AS (SELECT p.stay_id, p.stay_time, hr_raw, temp_raw, last_value(hr_raw IGNORE NULLS) OVER w AS hr_locf, last_value(temp_raw IGNORE NULLS) OVER w AS temp_locf, split FROM panel p JOIN splits s ON p.stay_id = s.stay_id AND rep = 0 WINDOW w AS (PARTITION BY p.stay_id ORDER BY stay_time ROWS UNBOUNDED PRECEDING)),
med AS (SELECT median(hr_locf) AS h, median(temp_locf) AS t FROM part WHERE split = 'train'),
filled_in AS (SELECT stay_id, stay_time, split, coalesce(hr_locf, h) AS hr, coalesce(temp_locf, t) AS temp FROM part, med),
ends AS (SELECT quantile_cont(hr, 0.02) AS h0, quantile_cont(hr, 0.98) AS h1, quantile_cont(temp, 0.02) AS t0, quantile_cont(temp, 0.98) AS t1 FROM filled_in WHERE split = 'train'),
clipped AS (SELECT stay_id, stay_time, split, least(greatest(hr, h0), h1) AS hr, least(greatest(temp, t0), t1) AS temp FROM filled_in, ends),
norm AS (SELECT avg(hr) AS hm, stddev_samp(hr) AS hs, avg(temp) AS tm, stddev_samp(temp) AS ts FROM clipped WHERE split = 'train')
"""


@query("SELECT stay_id, stay_time, round((hr - hm) / hs, 6) AS hr_locf, round((temp - tm) / ts, 6) AS temp_locf FROM clipped, norm WHERE split = 'test'", _FIT)
def fitted_pipeline(spark, d):
    """Steps fitted on the training stays, saved, read again and applied to the test stays."""
    p = once(panel(spark, d).select("stay_id", "stay_time", "hr_raw", "temp_raw"), "panel")
    parts = once(SP.stratified_split(stays(spark, d)).where("rep = 0"), "splits")
    of = lambda split: p.join(parts.where(F.col("split") == split).select("stay_id"), "stay_id", "left_semi")
    columns = ["hr_locf", "temp_locf"]
    made = fitted.fit(of("train"), [
        ("carry on", "locf", {"columns": ["hr_raw", "temp_raw"]}), ("only these", "select", {"columns": ["stay_id", "stay_time", *columns]}), ("fill", "impute_median", {"columns": columns}),
        ("clip", "clip", {"columns": columns, "low": 0.02, "high": 0.98}), ("normalise", "zscore", {"columns": columns})], kept=lambda df: once(df, "carried"))
    path = scratch(spark, "pipeline")
    made.save(path)
    return rounded(fitted.load(spark, path).transform(of("test")))


@query()
def tree_scores(spark, d):
    rows = _model_rows(spark, d)
    model = M.fit(rows.where("fold <> 0"), "forest", _FEATURES, numTrees=5, maxDepth=4)
    return M.score(model, rows.where("fold = 0"), _FEATURES)


@query()
def batch_scoring(spark, d):
    """A linear model of one third of the stays, scoring the others."""
    rows = _model_rows(spark, d)
    return M.score(M.fit(rows.where("fold = 0"), "linear", _FEATURES), rows.where("fold <> 0"), _FEATURES)


@query()
def backward_elimination(spark, d):
    rows = once(M.counted(_model_rows(spark, d), _FEATURES, ["label", "fold"]), "counted-rows")
    log = M.eliminate(rows, "boosted", _FEATURES, 1, "fold", weight="weight", maxIter=3, maxDepth=3)
    return spark.createDataFrame(log, "round int, dropped string, auroc double")


@query()
def platt_recalibration(spark, d):
    p = predictions(spark, d)
    return M.recalibrated(p.where("stay_id % 2 = 0"), p.where("stay_id % 2 = 1"), "platt", ("stay_id", "stay_time", "label"))


@query()
def isotonic_recalibration(spark, d):
    p = predictions(spark, d)
    return M.recalibrated(p.where("stay_id % 2 = 0"), p.where("stay_id % 2 = 1"), "isotonic", ("stay_id", "stay_time", "label"))


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("SELECT user_id AS stay_id, ts AS alarm_ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events WHERE value >= 300) WHERE r = 1")
def stream_first_alarm(spark, d):
    """Each user's first value of at least 300, found by the streaming job over the events file."""
    stream = alarms.read_stream(spark, d, _EVENTS, "events.parquet")
    table_, mark = scratch(spark, "alarms"), scratch(spark, "alarms-state")
    alarms.run_to_table(alarms.first_alarms(stream, 300.0), table_, mark)
    return spark.read.parquet(table_).select("stay_id", F.col("alarm_ts").cast("timestamp_ntz").alias("alarm_ts"), "value")


@query("SELECT hour, user_id, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS hour, user_id, event_type, value FROM events) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL")
def stream_hourly(spark, d):
    """Hourly means by user and type up to the watermark, from the streaming job over the events file."""
    stream = alarms.read_stream(spark, d, _EVENTS, "events.parquet")
    table_, mark = scratch(spark, "hourly"), scratch(spark, "hourly-state")
    alarms.run_to_table(alarms.hourly_means(stream), table_, mark)
    return rounded(spark.read.parquet(table_).withColumn("hour", F.col("hour").cast("timestamp_ntz")))


def _in_slices(spark, d, job, slices: int = 3):
    """The events as they'd arrive, up to an hour late, in slices of time: each is written and the job, begun anew, goes through it."""
    events = table(spark, d, "events").withColumn("value", F.floor("value").cast("double"))
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod("event_id", F.lit(3600)) * 1_000_000
    ends = events.agg(F.min(arrival).alias("low"), F.max(arrival).alias("high")).first()
    step = (ends.high - ends.low) // slices + 1
    source, out, mark = scratch(spark, "arrivals"), scratch(spark, "told"), scratch(spark, "told-state")
    for k in range(slices):
        events.where((arrival >= ends.low + k * step) & (arrival < ends.low + (k + 1) * step)).write.mode("append").parquet(source)
        alarms.run_to_table(job(alarms.read_stream(spark, source, _EVENTS, files_a_batch=None)), out, mark)
    return spark.read.parquet(out)


@query("SELECT stay_id, ts AS alarm_ts, value FROM (SELECT user_id AS stay_id, ts, floor(value) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, floor(value)) AS r FROM events WHERE floor(value) >= 300) WHERE r = 1 AND ts <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def stream_first_alarm_by_time(spark, d):
    """Each user's first high value by event time, over late rows and restarts of the job."""
    told = _in_slices(spark, d, lambda s: alarms.first_alarms_by_time(s, 300.0))
    return told.select("stay_id", F.col("alarm_ts").cast("timestamp_ntz").alias("alarm_ts"), "value")


@query("SELECT f.stay_id, stay_time, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*RAW, *LOCF]) + " FROM filled f JOIN t0 ON f.stay_id = t0.stay_id WHERE t0 + to_hours(CAST(stay_time + 1 AS INTEGER)) <= (SELECT max(ts) - INTERVAL 2 HOUR FROM ev)", FILLED)
def stream_grid(spark, d):
    """The complete hourly grid with values carried on, told hour by hour, over late rows and restarts of the job."""
    return rounded(_in_slices(spark, d, lambda s: alarms.hourly_grid(s, NAMES)))
