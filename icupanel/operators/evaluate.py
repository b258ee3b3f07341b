"""Patient-level and time-point evaluation of early-warning scores.

Threshold sweeps never cross rows with thresholds: for patients only the rows
where a stay's running maximum rises can set off a first alarm, and for time
points one histogram of scores over the thresholds is summed from above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icupanel.functions.windows import by_stay, so_far, sticky
from icupanel.operators.ordered import running_sums

ID, TIME = "stay_id", "stay_time"


def thresholds(rows: DataFrame, score: str = "score", n: int = 100, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(thres_no, thres): `n` even steps between two exact percentiles of the scores."""
    return _even(quantiles(rows, score, (low, high)), n)


def range_thresholds(rows: DataFrame, score: str = "score", n: int = 100) -> DataFrame:
    """(thres_no, thres): `n` even steps between the least and the largest score."""
    return _even(rows.agg(F.array(F.min(score).cast("double"), F.max(score).cast("double")).alias("q")), n)


def peak_thresholds(rows: DataFrame, score: str = "score", n: int = 100) -> DataFrame:
    """(thres_no, thres): the quantiles of the stays' highest scores at `n` even steps from 0 to 1."""
    peaks = rows.groupBy(ID).agg(F.max(score).alias("peak"))
    return quantiles(peaks, "peak", [k / (n - 1) for k in range(n)]).select(F.posexplode("q").alias("thres_no", "thres"))


def quantiles(rows: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(…by, q), the exact interpolated quantiles: one row, or one a group that has values.

    Ranks are running sums of counts in ordered buckets, in every group for
    itself: no sort and no buffer holds the values of a whole group.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranked = running_sums(counts, "v", ["n"], by)
    place = [F.lit(float(s)) * (F.col("n_all") - 1) for s in shares]
    at = lambda rank: F.min(F.when(F.col("n_sum") > rank, F.col("v")))
    ends = ranked.groupBy(*by).agg(F.max("n_all").alias("n"), *[at(f(p)).alias(f"{k}{i}") for i, p in enumerate(place) for k, f in (("a", F.floor), ("b", F.ceil))])
    part = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    return ends.select(*by, F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (p - F.floor(p)) for i, p in enumerate(part)]).alias("q"))


def _even(ends: DataFrame, n: int) -> DataFrame:
    step = (F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / (n - 1)
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("thres_no"), "q").select("thres_no", (F.get("q", F.lit(0)) + F.col("thres_no") * step).alias("thres"))


def steps_reached(score: Column, cuts: Sequence[float], strict: bool = False) -> Column:
    """How many of the rising `cuts` a score reaches, or exceeds if `strict`: a binary search written as nested conditions, so that it stays in generated code."""
    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        cut = F.lit(float(cuts[mid]))
        return F.when(score > cut if strict else score >= cut, among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(cuts))


def threshold_list(grid: DataFrame) -> list[float]:
    """The grid on the driver: as many numbers as thresholds, rising."""
    return [r.thres for r in grid.orderBy("thres_no").collect()]


def records(rows: DataFrame, score: str = "score") -> DataFrame:
    """Rows where a stay's score rises above all before: (stay_id, stay_time, was, top)."""
    before = F.max(score).over(by_stay().rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("was", before).where(F.col(score).isNotNull() & (F.col("was").isNull() | (F.col(score) > F.col("was"))))
    return out.select(ID, TIME, "was", F.col(score).alias("top"))


def first_alarms(rows: DataFrame, cuts: Sequence[float], score: str = "score", strict: bool = False) -> DataFrame:
    """(stay_id, thres_no, alarm_time) for every threshold a stay reaches."""
    order = sorted(range(len(cuts)), key=lambda k: cuts[k])
    rising = [cuts[k] for k in order]
    reached = records(rows, score).select(ID, F.col(TIME).alias("alarm_time"), steps_reached(F.col("was"), rising, strict).alias("low"), steps_reached(F.col("top"), rising, strict).alias("high"))
    new = reached.where("high > low").select(ID, F.explode(F.sequence("low", F.col("high") - 1)).alias("k"), "alarm_time")
    number = F.col("k") if order == list(range(len(cuts))) else F.get(F.array(*map(F.lit, order)), F.col("k"))
    return new.select(ID, number.cast("int").alias("thres_no"), "alarm_time")


def stay_truth(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(ID).agg(F.min(F.when(F.col(label) == 1, F.col(TIME))).alias("onset"))


def patient_sweep(rows: DataFrame, cuts: Sequence[float], score: str = "score", label: str = "label", strict: bool = False) -> DataFrame:
    """One row a threshold: recall, precision, specificity, earliness and shares alarmed more than 0 to 10 hours ahead."""
    truth = stay_truth(rows, label)
    totals = truth.agg(F.count("onset").alias("cases"), F.count_if(F.col("onset").isNull()).alias("controls"))
    alarms = first_alarms(rows, cuts, score, strict).join(truth, ID).withColumn("ahead", F.col("onset") - F.col("alarm_time"))
    n = F.count
    per = alarms.groupBy("thres_no").agg(
        n("onset").alias("tp"), F.count_if(F.col("onset").isNull()).alias("fp"), F.avg("ahead").alias("earliness_mean"), F.percentile("ahead", F.lit(0.5)).alias("earliness_median"),
        F.min("ahead").alias("earliness_min"), F.max("ahead").alias("earliness_max"), *[F.count_if(F.col("ahead") > k).alias(f"ahead_{k}") for k in range(11)])
    spark = rows.sparkSession
    grid = spark.createDataFrame([(i, float(c)) for i, c in enumerate(cuts)], "thres_no int, thres double")
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return F.broadcast(grid).join(per, "thres_no", "left").join(F.broadcast(totals), F.lit(True)).select(
        "thres_no", "thres", safe(z("tp"), F.col("cases")).alias("pat_recall"), safe(z("tp"), z("tp") + z("fp")).alias("pat_precision"),
        (1 - safe(z("fp"), F.col("controls"))).alias("pat_specificity"), *[f"earliness_{k}" for k in ("mean", "median", "min", "max")],
        *[safe(z(f"ahead_{k}"), F.col("cases")).alias(f"proportion_{k}_hours_before_onset") for k in range(11)])


def timepoint_sweep(rows: DataFrame, cuts: Sequence[float], score: str = "score", label: str = "label") -> DataFrame:
    """(thres_no, thres, tp_recall, tp_precision) over all rows with label and score; thresholds have to rise."""
    met = steps_reached(F.col("_s"), cuts)
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).alias("_s"), F.col(label).cast("int").alias("_l"))
    hist = known.select(met.alias("met"), "_l").groupBy("met").agg(F.sum("_l").alias("ones"), F.count("*").alias("n"))
    grid = rows.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(cuts)], "thres_no int, thres double")
    whole = known.agg(F.sum("_l").alias("positives"))
    # at most one row a threshold on both sides
    sums = grid.join(F.broadcast(hist), F.col("met") > F.col("thres_no"), "left").groupBy("thres_no", "thres").agg(F.coalesce(F.sum("ones"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("alarms"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.join(F.broadcast(whole), F.lit(True)).select("thres_no", "thres", safe(F.col("tp"), F.col("positives")).alias("tp_recall"), safe(F.col("tp"), F.col("alarms")).alias("tp_precision"))


def utility_sweep(rows: DataFrame, cuts: Sequence[float], score: str = "score", utility: str = "utility") -> DataFrame:
    """(thres_no, thres, utility): utility of all rows above each rising threshold, as a share of the best, the sum of all positive utilities."""
    known = rows.where(F.col(score).isNotNull()).select(steps_reached(F.col(score), cuts, strict=True).alias("met"), F.col(utility).alias("u"))
    hist = known.groupBy("met").agg(F.sum("u").alias("u"))
    best = rows.agg(F.sum(F.greatest(F.col(utility), F.lit(0.0))).alias("best"))
    grid = rows.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(cuts)], "thres_no int, thres double")
    # at most one row a threshold on both sides
    sums = grid.join(F.broadcast(hist), F.col("met") > F.col("thres_no"), "left").groupBy("thres_no", "thres").agg(F.coalesce(F.sum("u"), F.lit(0.0)).alias("u"))
    return sums.join(F.broadcast(best), F.lit(True)).select("thres_no", "thres", F.try_divide("u", "best").alias("utility"))


def score_counts(rows: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Counts at and above each distinct score: (…by, score, p, q at it, tp, fp, positives, negatives); a row counts `weight` times."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    one, times = F.col(label).cast("long"), F.lit(1) if weight is None else F.col(weight)
    per = known.groupBy(*by, F.col(score).alias("score")).agg(F.sum(one * times).alias("p"), F.sum((1 - one) * times).alias("q"))
    names = {"p_sum": "tp", "q_sum": "fp", "p_all": "positives", "q_all": "negatives"}
    return running_sums(per, "score", ["p", "q"], by, descending=True).withColumnsRenamed(names)


def auroc_auprc(rows: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """AUROC and AUPRC by trapezoids and average precision by steps over distinct scores; (0,0) and, for precision, (0,1) come first."""
    c = score_counts(rows, score, label, by, weight)
    tp, fp, p, q = (F.col(x) for x in ("tp", "fp", "p", "q"))
    dx, dy = F.try_divide(q, "negatives"), F.try_divide(p, "positives")
    tpr, precision = F.try_divide(tp, "positives"), F.try_divide(tp, tp + fp)
    before = F.coalesce(F.try_divide(tp - p, tp - p + fp - q), F.lit(1.0))
    return c.groupBy(*by).agg(
        F.sum(dx * (tpr - dy / 2)).alias("auroc"), F.sum(dy * (precision + before) / 2).alias("auprc"), F.sum(dy * precision).alias("average_precision"))


def confusion(rows: DataFrame, prediction: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, F measure and balanced accuracy of 0/1 predictions."""
    cell = lambda p, t: F.count_if((F.col(prediction) == p) & (F.col(label) == t))
    c = rows.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumn("accuracy", F.try_divide(tp + tn, tp + fp + fn + tn)).withColumn("f_measure", F.try_divide(2 * tp, 2 * tp + fp + fn)).withColumn(
        "balanced_accuracy", (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2)


def interpolated(points: DataFrame, x: str, y: str, n: int = 200, by: Sequence[str] = (), first: tuple[float, float] = (0.0, 0.0), last: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(…by, grid_no, x, y): a curve at `n` even steps of [0, 1], linear in x between its points.

    Each segment is spread over the steps that fall in it, so no curve is
    crossed with the grid.  Of points with equal x the largest y counts.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(a).cast("double").alias("x"), F.lit(b).cast("double").alias("y")) for a, b in (first, last)]))
    groups = points.select(*by).distinct() if by else points.sparkSession.range(1).select()
    rows = points.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).unionByName(groups.select(*by, ends.alias("e")).select(*by, "e.x", "e.y"))
    # only the first and last point between two steps matter: at most 2 n points a curve are left
    at_x, low_y, high_y = F.col("x"), F.struct(F.col("x"), -F.col("y")), F.struct(F.col("x"), F.col("y"))
    cell = rows.groupBy(*by, F.floor(F.round(at_x * (n - 1), 9)).alias("cell")).agg(F.min(low_y).alias("a"), F.max(high_y).alias("b"))
    both = F.array(F.struct(F.col("a.x").alias("x"), (-F.col("a.col2")).alias("y")), F.struct(F.col("b.x").alias("x"), F.col("b.y").alias("y")))
    one = cell.select(*by, F.explode(F.array_distinct(both)).alias("e")).select(*by, "e.x", "e.y").groupBy(*by, "x").agg(F.max("y").alias("y"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("x")
    seg = one.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w))
    low = F.ceil(F.round(F.col("x") * (n - 1), 9))
    high = F.when(F.col("x1").isNull(), F.floor(F.round(F.col("x") * (n - 1), 9))).otherwise(F.ceil(F.round(F.col("x1") * (n - 1), 9)) - 1)
    steps = seg.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("grid_no", F.explode(F.sequence("low", "high")))
    at = F.col("grid_no") / (n - 1)
    value = F.coalesce(F.col("y") + F.try_divide((F.col("y1") - F.col("y")) * (at - F.col("x")), F.col("x1") - F.col("x")), F.col("y"))
    return steps.select(*by, F.col("grid_no").cast("int").alias("grid_no"), at.alias("x"), value.alias("y"))


def trapezoid(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("grid_no")
    area = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2
    return curve.withColumn("a", area).groupBy(*by).agg(F.sum("a").alias("auc"))


def curve_bands(curve: DataFrame, over: Sequence[str] = ("grid_no", "x")) -> DataFrame:
    return curve.groupBy(*over).agg(F.percentile("y", F.lit(0.5)).alias("median"), F.min("y").alias("low"), F.max("y").alias("high"), F.avg("y").alias("mean"))


def at_recall(table: DataFrame, recall: str, level: float, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """`values` where recall meets `level`, linear between the nearest rows above and below."""
    above = F.min(F.when(F.col(recall) >= level, F.struct(F.col(recall).alias("r"), *values)))
    below = F.max(F.when(F.col(recall) <= level, F.struct(F.col(recall).alias("r"), *values)))
    ends = table.groupBy(*by).agg(above.alias("a"), below.alias("b"))
    t = F.coalesce(F.try_divide(F.lit(level) - F.col("b.r"), F.col("a.r") - F.col("b.r")), F.lit(0.0))
    return ends.select(*by, *[F.coalesce(F.col(f"b.{v}") + t * (F.col(f"a.{v}") - F.col(f"b.{v}")), F.col(f"a.{v}"), F.col(f"b.{v}")).alias(v) for v in values])


def operating_point(table: DataFrame, recall: str, above: float, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The row of the smallest recall above a level; ties to the largest threshold."""
    return table.where(F.col(recall) > above).groupBy(*by).agg(F.min(F.struct(F.col(recall), (-F.col("thres")).alias("_t"), *values)).alias("r")).select(*by, f"r.{recall}", (-F.col("r._t")).alias("thres"), *[f"r.{v}" for v in values])


def pooled(scores: Sequence[DataFrame] | DataFrame, keys: Sequence[str], score: str = "score", models: int | None = None, how: str = "max") -> DataFrame:
    """Models' scores of the same rows pooled by max or mean; a key that not every model has raises an error at run time."""
    rows, n = (scores, models) if isinstance(scores, DataFrame) else (None, len(scores))
    if rows is None:
        rows = scores[0]
        for other in scores[1:]:
            rows = rows.unionByName(other)
    agg = {"max": F.max, "mean": F.avg}[how]
    out = rows.groupBy(*keys).agg(agg(score).alias(score), F.count("*").alias("n_models"))
    return out.withColumn(score, F.when(F.col("n_models") != n, F.raise_error(F.lit("pooled: keys differ between models")).cast("double")).otherwise(F.col(score)))


def to_stays(rows: DataFrame, score: str, label: str) -> DataFrame:
    return rows.groupBy(ID).agg(F.avg(score).alias("score"), F.max(label).alias("label"))


def calibration(rows: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share): reliability over even bins of [0, 1]."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share"))


def calibration_bands(rows: DataFrame, score: str = "score", label: str = "label", rep: str = "rep", bins: int = 10) -> DataFrame:
    """(grid_no, x, mean, std, n_mean, n_std) over repetitions: reliability brought to `bins` even points of [0, 1], and the histogram of scores.

    Between the mean scores of a repetition's bins the share is linear, outside
    them it stays at the nearest one's; deviations are of the population.  Only
    `bins` rows a repetition are gathered.
    """
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    points = known.groupBy(rep, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("x"), F.avg(F.col(label).cast("double")).alias("y"))
    curves = points.groupBy(rep).agg(F.sort_array(F.collect_list(F.struct("x", "y", "bin", "n"))).alias("curve"))
    at = curves.select(rep, "curve", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("grid_no")).withColumn("at", F.col("grid_no") / (bins - 1))
    low = F.element_at(F.concat(F.slice("curve", 1, 1), F.filter("curve", lambda p: p["x"] <= F.col("at"))), -1)
    high = F.element_at(F.concat(F.filter("curve", lambda p: p["x"] >= F.col("at")), F.slice("curve", -1, 1)), 1)
    n = F.aggregate("curve", F.lit(0).cast("long"), lambda s, p: s + F.when(p["bin"] == F.col("grid_no"), p["n"]).otherwise(0))
    ends = at.select(rep, "grid_no", "at", low.alias("low"), high.alias("high"), n.alias("n"))
    share = F.least(F.greatest(F.coalesce(F.try_divide(F.col("at") - F.col("low.x"), F.col("high.x") - F.col("low.x")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    value = F.col("low.y") + share * (F.col("high.y") - F.col("low.y"))
    return ends.withColumn("y", value).groupBy("grid_no", F.col("at").alias("x")).agg(
        F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.avg("n").alias("n_mean"), F.stddev_pop("n").alias("n_std"))


def alarm_against_treatment(rows: DataFrame, treatments: DataFrame, cut: float, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Stays by whether the first alarm came before the first treatment, not before it, or never, and the mean lead."""
    alarm = rows.groupBy(*by, ID).agg(F.min(F.when(F.col(score) >= cut, F.col(TIME))).alias("alarm"))
    treated = treatments.groupBy(F.col(ID).alias("_id")).agg(F.min("treat_time").alias("treated"))
    met = alarm.join(treated, F.col(ID) == F.col("_id"), "left")
    before = F.col("alarm") < F.col("treated")
    return met.groupBy(*by).agg(
        F.count_if(F.coalesce(before, F.lit(False))).alias("before"), F.count_if(F.coalesce(~before, F.lit(False))).alias("not_before"),
        F.count_if(F.col("alarm").isNull()).alias("no_alarm"), F.count_if(F.col("treated").isNull()).alias("untreated"), F.avg(F.col("treated") - F.col("alarm")).alias("mean_lead"))


def hourly_flow(rows: DataFrame, treatments: DataFrame, cut: float, hours: int = 100, score: str = "score") -> DataFrame:
    """(hour, at_risk, alarmed, treated, onsets): stays so far by each hour of the first `hours`; long counts are summed, stays aren't crossed with hours."""
    per = rows.groupBy(ID).agg(F.min(TIME).alias("first"), F.max(TIME).alias("last"), F.min(F.when(F.col(score) >= cut, F.col(TIME))).alias("alarm"), F.min(F.when(F.col("label") == 1, F.col(TIME))).alias("onset"))
    treated = treatments.groupBy(F.col(ID).alias("_id")).agg(F.min("treat_time").alias("treated"))
    met = per.join(treated, F.col(ID) == F.col("_id"), "left")
    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.when(t.isNotNull(), F.greatest(t, F.lit(0))).alias("hour")) for k, t in (
        ("entered", F.col("first")), ("left", F.col("last") + 1), ("alarmed", F.col("alarm")), ("treated", F.col("treated")), ("onsets", F.col("onset")))]))
    counts = met.select(marks.alias("m")).select("m.*").where("hour is not null").groupBy("hour").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("entered", "left", "alarmed", "treated", "onsets")])
    grid = rows.sparkSession.range(hours).select(F.col("id").alias("hour"))
    # beyond the last hour nothing is shown, so one row an hour is left
    w = Window.partitionBy(F.lit(0)).orderBy("hour")
    c = grid.join(counts, "hour", "left").fillna(0)
    s = lambda k: F.sum(k).over(w)
    return c.select("hour", (s("entered") - s("left")).alias("at_risk"), s("alarmed").alias("alarmed"), s("treated").alias("treated"), s("onsets").alias("onsets"))


def sticky_alarm(rows: DataFrame, cut: float, score: str = "score") -> DataFrame:
    return rows.withColumn("alarm", sticky(F.col(score) >= cut))


def min_max_scaled(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    ends = table.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    lit = lambda x: F.lit(x).cast("double")
    return table.withColumns({f"{c}_scaled": F.try_divide(F.col(c) - lit(ends[f"lo_{c}"]), lit(ends[f"hi_{c}"]) - lit(ends[f"lo_{c}"])) for c in columns})


def running_max(score: Column) -> Column:
    return F.max(score).over(so_far())
