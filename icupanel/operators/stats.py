"""Descriptive statistics, normalisation, intervals and tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icupanel.functions import probability
from icupanel.operators.evaluate import quantiles
from icupanel.operators.ordered import running_sums

ID, TIME = "stay_id", "stay_time"


def normaliser(panel: DataFrame, columns: Sequence[str], ids: DataFrame | None = None, eps: float | None = 0.01) -> DataFrame:
    """(column, mean, std) over the given stays' rows; a deviation below `eps` becomes 1, a null one stays null."""
    rows = panel if ids is None else panel.join(ids.select(ID).hint("shuffle_hash"), ID, "left_semi")
    one = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)])
    std = lambda i: F.when(F.col(f"s{i}") < eps, 1.0).otherwise(F.col(f"s{i}")) if eps is not None else F.col(f"s{i}")
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), std(i).alias("std")) for i, c in enumerate(columns)]))
    return one.select(long.alias("r")).select("r.*")


def zscored(panel: DataFrame, stats: DataFrame, inverse: bool = False) -> DataFrame:
    """Columns of `stats` normalised, or back; one row a column reaches the driver and becomes literals."""
    known = {r["column"]: (r["mean"], r["std"]) for r in stats.collect()}
    lit = lambda x: F.lit(x).cast("double")
    return panel.withColumns({c: (F.col(c) * lit(s) + lit(m)) if inverse else F.try_divide(F.col(c) - lit(m), lit(s)) for c, (m, s) in known.items()})


def on_normalised(panel: DataFrame, stats: DataFrame, transforms: Sequence) -> DataFrame:
    """New columns of `transforms` computed on a normalised copy, beside the original columns, which are carried along in one pass."""
    carried = panel.withColumn("_originals", F.struct(*panel.columns))
    copy = reduce(lambda df, f: f(df), transforms, zscored(carried, stats))
    made = [c for c in copy.columns if c not in carried.columns]
    return copy.select("_originals.*", *made)


def rows_per_stay(rows: DataFrame) -> DataFrame:
    return rows.groupBy(ID).agg(F.count("*").alias("n_rows"))


def stay_labels(panel: DataFrame, label: str = "sep3") -> DataFrame:
    """1 where any of a stay's labels is 1, nulls aside."""
    return panel.groupBy(ID).agg(F.coalesce(F.max(F.col(label).cast("int")), F.lit(0)).alias("label"))


def prevalence(panel: DataFrame, by: Sequence[str] = (), label: str = "sep3") -> DataFrame:
    """Rows, stays and cases, and the shares of labelled rows and of cases."""
    per = panel.groupBy(*by, ID).agg(F.max(label).alias("case"), F.count(label).alias("n"), F.sum(label).alias("ones"))
    return per.groupBy(*by).agg(
        F.count("*").alias("stays"), F.sum(F.coalesce("case", F.lit(0.0))).cast("long").alias("cases"), F.sum("n").alias("time_points"),
        F.try_divide(F.sum("ones"), F.sum("n")).alias("time_prevalence"), F.avg(F.coalesce("case", F.lit(0.0))).alias("case_prevalence"))


def imbalance(panel: DataFrame, label: str = "sep3") -> DataFrame:
    """(group, stays, mean, std, median of lengths, mean share of labelled ones) for all stays, cases and controls."""
    per = panel.groupBy(ID).agg(F.count("*").alias("length"), F.max(label).alias("case"), F.avg(label).alias("ones"))
    group = F.explode(F.array(F.lit("all"), F.when(F.col("case") == 1, "case").otherwise("control")))
    each = per.withColumn("group", group)
    means = each.groupBy("group").agg(F.count("*").alias("stays"), F.avg("length").alias("mean_length"), F.stddev_samp("length").alias("std_length"), F.avg("ones").alias("mean_ones"))
    return _with_quantiles(means, each, "length", {"median_length": 0.5}, ["group"]).select("group", "stays", "mean_length", "std_length", "median_length", "mean_ones")


def _with_quantiles(groups: DataFrame, rows: DataFrame, column: str, shares: dict[str, float], by: Sequence[str]) -> DataFrame:
    """`groups`, one row for each `by`, with exact quantiles of a column of `rows`; null where a group has no value."""
    q = quantiles(rows, column, list(shares.values()), by).select(*[F.col(c).alias(f"_q_{c}") for c in by], F.col("q").alias("_q"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by], F.lit(True))
    return groups.join(q, on, "left").select(*groups.columns, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(shares)])


def imbalance_factor(rows: DataFrame, label: str) -> DataFrame:
    p = F.avg(F.col(label).cast("double"))
    return rows.agg(F.try_divide(1 - p, p).alias("factor"))


def median_iqr(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(…by, variable, n, q25, median, q75), exact."""
    long = rows.unpivot(list(by), list(columns), "variable", "v")
    n = long.groupBy(*by, "variable").agg(F.count("v").alias("n"))
    return _with_quantiles(n, long, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75}, [*by, "variable"])


def counts_per_stay(rows: DataFrame, columns: Sequence[str], upto: int = 24) -> DataFrame:
    """(variable, n, per_stay, q25, median, q75) over the first `upto` hours."""
    early = rows.where(F.col(TIME) <= upto)
    n = early.select(F.countDistinct(ID).alias("_n"))
    return median_iqr(early, columns).join(F.broadcast(n), F.lit(True)).withColumn("per_stay", F.col("n") / F.col("_n")).drop("_n")


def level_percent(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    n = rows.groupBy(*by, column).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))


def characteristics(table: DataFrame, source: str, variable: str, shown: str, sources: Sequence[str]) -> DataFrame:
    """Variables by sources; "-" where a source has none."""
    return table.groupBy(variable).pivot(source, list(sources)).agg(F.first(shown)).fillna("-")


def ever(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return rows.groupBy(ID).agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()])


def code_flags(codes: DataFrame, code: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Per stay, whether any code (before its first comma) starts with one of a group's prefixes."""
    head = F.trim(F.split(code, ",")[0])
    hit = lambda prefixes: reduce(lambda a, b: a | b, [head.startswith(p) for p in prefixes])
    return ever(codes, {g: hit(p) for g, p in groups.items()})


def mapped_codes(codes: DataFrame, code: str, mapping: DataFrame, prefix: str = "prefix", group: str = "group") -> DataFrame:
    """`codes` with the group of the longest prefix in `mapping` that begins each code (up to its first comma); null where none does.

    Distinct codes are spread into their prefixes and joined on equality, so the
    map may be of any size.  A prefix with several groups gives the first of
    them by name; null and empty prefixes match nothing.
    """
    head = F.trim(F.split(F.col(code), ",")[0])
    known = mapping.where(F.length(prefix) > 0).groupBy(F.col(prefix).alias("_prefix")).agg(F.min(group).alias(group))
    heads = codes.select(head.alias("_head")).where(F.length("_head") > 0).distinct()
    spread = heads.withColumn("_size", F.explode(F.sequence(F.lit(1), F.length("_head")))).withColumn("_part", F.substring("_head", F.lit(1), F.col("_size")))
    best = spread.join(known, F.col("_part") == F.col("_prefix")).groupBy("_head").agg(F.max_by(group, "_size").alias(group))
    return codes.withColumn("_code", head).join(best, F.col("_code") == F.col("_head"), "left").drop("_code", "_head")


def group_flags(codes: DataFrame, code: str, mapping: DataFrame, groups: Sequence[str], prefix: str = "prefix", group: str = "group") -> DataFrame:
    """Per stay, whether it has a code of each group by `mapped_codes`."""
    return ever(mapped_codes(codes, code, mapping, prefix, group), {g: F.col(group) == g for g in groups})


def grouped_std(rows: DataFrame, by: str, column: str, within: Column | None = None) -> DataFrame:
    """Deviation of a column by flag, over the rows that lie `within` a window if one is given."""
    return (rows if within is None else rows.where(within)).groupBy(by).agg(F.count(column).alias("n"), F.stddev_samp(column).alias("std"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    width = (high - low) / bins
    bin_ = F.least(F.greatest(F.floor((F.col(column) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(column).isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))


def _in_splits(panel: DataFrame, splits: DataFrame, columns: Sequence[str]) -> DataFrame:
    met = panel.select(ID, *columns).join(splits.select("rep", "split", F.col(ID).alias("_id")).hint("shuffle_hash"), F.col("_id") == F.col(ID))
    return met.unpivot(["rep", "split"], list(columns), "variable", "v")


def split_quantiles(panel: DataFrame, splits: DataFrame, columns: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """(rep, split, variable, n, …shares): exact quantiles of features in each split."""
    long = _in_splits(panel, splits, columns)
    by = ["rep", "split", "variable"]
    return _with_quantiles(long.groupBy(*by).agg(F.count("v").alias("n")), long, "v", shares, by)


def split_histograms(panel: DataFrame, splits: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(rep, split, variable, bin, low, high, n, share): features in each split over even bins between the whole panel's least and largest value.

    The ends are two numbers a feature; a feature of one value has one bin.
    """
    ends = panel.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    spans = panel.sparkSession.createDataFrame([(c, ends[f"lo{i}"], ends[f"hi{i}"]) for i, c in enumerate(columns)], "_variable string, _low double, _high double")
    long = _in_splits(panel, splits, columns).where(F.col("v").isNotNull()).join(F.broadcast(spans), F.col("variable") == F.col("_variable"))
    width = (F.col("_high") - F.col("_low")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("_low")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    by = ["rep", "split", "variable"]
    n = long.groupBy(*by, bin_.alias("bin"), (F.col("_low") + bin_ * width).alias("low"), (F.col("_low") + (bin_ + 1) * width).alias("high")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def split_distribution(panel: DataFrame, splits: DataFrame, column: str, label: str = "sep3") -> DataFrame:
    """(rep, split, stays, mean_length, ones, zeros, n, mean, std) of a panel's stays in each split."""
    per = panel.groupBy(ID).agg(
        F.count("*").alias("length"), F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"),
        F.count(column).alias("n"), F.sum(column).alias("s"), F.sum(F.col(column) * F.col(column)).alias("ss"))
    met = splits.select("rep", "split", F.col(ID).alias("_id")).join(per, F.col("_id") == F.col(ID))
    sums = met.groupBy("rep", "split").agg(F.count("*").alias("stays"), F.avg("length").alias("mean_length"), *[F.sum(c).alias(c) for c in ("ones", "zeros", "n", "s", "ss")])
    mean = F.try_divide("s", "n")
    return sums.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("ss") - F.col("s") * F.col("mean"), F.col("n") - 1)))).drop("s", "ss")


def onset_times(stays: DataFrame, label: str = "label", onset: str = "onset", end: str = "outtime") -> DataFrame:
    """(label, stays, mean_onset, first_onset, last_onset, mean_end): when cases set on and stays end, by label."""
    return stays.groupBy(label).agg(
        F.count("*").alias("stays"), F.avg(onset).alias("mean_onset"), F.min(onset).alias("first_onset"), F.max(onset).alias("last_onset"), F.avg(end).alias("mean_end"))


def shape(rows: DataFrame) -> DataFrame:
    """One row: rows, stays, columns and the largest and smallest number of rows of a stay."""
    per = rows.groupBy(ID).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("stays"), F.lit(len(rows.columns)).alias("columns"), F.max("n").alias("most"), F.min("n").alias("least"))


def merged_rankings(tables: dict[str, DataFrame], key: str = "feature", value: str = "rank") -> DataFrame:
    """Ranking tables side by side: a column of each table's `value` per key; null where a table lacks the key."""
    each = [t.select(key, F.col(value).alias(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), each)


def missing_report(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot("rows", list(columns), "column", "missing").withColumn("share", F.try_divide("missing", "rows"))


def availability(concepts: DataFrame, source: str, sources: Sequence[str]) -> DataFrame:
    """Concepts by sources: yes if any value, no if only nulls, unknown if no row."""
    seen = concepts.groupBy("concept", source).agg(F.when(F.count("value") > 0, "yes").otherwise("no").alias("has"))
    return seen.groupBy("concept").pivot(source, list(sources)).agg(F.first("has")).fillna("unknown")


def percentile_interval(rows: DataFrame, column: str, by: Sequence[str] = (), level: float = 95) -> DataFrame:
    tail = (100 - level) / 200
    return _with_quantiles(rows.groupBy(*by).agg(F.avg(column).alias("mean")), rows, column, {"low": tail, "high": 1 - tail}, by)


def gaussian_interval(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    m, s = F.avg(column), F.stddev_pop(column)
    return rows.groupBy(*by).agg(m.alias("mean"), (m - 1.96 * s).alias("low"), (m + 1.96 * s).alias("high"))


def mean_of_means_interval(rows: DataFrame, column: str, unit: Sequence[str], level: float = 95) -> DataFrame:
    """Percentile interval of the units' means, such as those of each (rep, subsample) over sites."""
    return percentile_interval(rows.groupBy(*unit).agg(F.avg(column).alias(column)), column, (), level)


def mean_std(rows: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.stddev_pop(column).alias("std_pop"))


def macro_micro(rows: DataFrame, column: str, unit: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean over all rows (micro) and over the units' means (macro)."""
    per = rows.groupBy(*by, *unit).agg(F.avg(column).alias("m"), F.sum(column).alias("s"), F.count(column).alias("n"))
    return per.groupBy(*by).agg(F.avg("m").alias("macro"), F.try_divide(F.sum("s"), F.sum("n")).alias("micro"))


def best_per_group(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """The largest value of each group and whose it is; ties to the first name."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), name))
    return rows.withColumn("_r", r).where("_r = 1").select(*by, F.col(value).alias("best"), F.col(name).alias("best_name"))


def metric_matrix(rows: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def internal_external(rows: DataFrame, train: str, evaluation: str, value: str) -> DataFrame:
    """Per training source: its own metric, the mean on others, and each relative to the evaluation source's own."""
    own = rows.where(F.col(train) == F.col(evaluation)).groupBy(F.col(evaluation).alias("_e")).agg(F.avg(value).alias("_own"))
    met = rows.join(own, F.col(evaluation) == F.col("_e"), "left")
    same = F.col(train) == F.col(evaluation)
    return met.groupBy(train).agg(
        F.avg(F.when(same, F.col(value))).alias("internal"), F.avg(F.when(~same, F.col(value))).alias("external"),
        F.avg(F.when(~same, F.try_divide(F.col(value), F.col("_own")))).alias("relative"))


def edges(rows: DataFrame, train: str, evaluation: str, value: str) -> DataFrame:
    return rows.where(F.col(train) != F.col(evaluation)).groupBy(train, evaluation).agg(F.avg(value).alias("weight"))


def weighted_mean(rows: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by a rational approximation (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 2 * F.exp(-z * z / 2) / 2.5066282746310002 * series


def paired_tests(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Paired t statistic and Wilcoxon's signed ranks with a normal approximation; zero differences are left out of the ranks."""
    d = rows.select((F.col(a) - F.col(b)).alias("d")).where("d is not null")
    t = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t"))
    sized = d.where("d <> 0").select(F.abs("d").alias("size"), (F.col("d") > 0).alias("up")).groupBy("size").agg(F.count("*").alias("k"), F.count_if("up").alias("ups"))
    # twice the mean ranks are whole numbers; products of counts go beyond 64 bits
    whole = lambda c: c.cast("decimal(19,0)")
    twice = running_sums(sized, "size", ["k"]).withColumn("twice", whole(F.col("ups")) * whole(2 * F.col("k_sum") - F.col("k") + 1))
    w = twice.agg((F.sum("twice").cast("double") / 2).alias("w"), F.sum("k").cast("double").alias("m"))
    z = (F.col("w") - F.col("m") * (F.col("m") + 1) / 4) / F.sqrt(F.col("m") * (F.col("m") + 1) * (2 * F.col("m") + 1) / 24)
    return t.join(w, F.lit(True)).withColumn("z", z).withColumn("p", normal_tail(F.col("z"))).drop("m")


def paired_tests_by(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(…by, n, mean_difference, t, p_t, m, w, p_w): paired t test and Wilcoxon's signed-rank test of each group, both two-sided.

    m counts the differences that aren't zero, which alone are ranked; ties share
    their mean rank.  p_w is exact up to 50 differences without ties, else by the
    normal distribution with the variance corrected for ties.  Rows with a null
    value are left out; p_t is null for fewer than two rows and for differences
    that are all equal.
    """
    d = rows.select(*by, (F.col(a) - F.col(b)).cast("double").alias("d")).where("d is not null")
    per = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("_s"))
    t = F.when(F.col("_s") > 0, F.col("mean_difference") / (F.col("_s") / F.sqrt("n")))
    tested = per.withColumn("t", t).withColumn("p_t", probability.t_two_sided(F.col("t"), F.col("n") - 1))
    sized = d.where("d <> 0").groupBy(*by, F.abs("d").alias("size")).agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("ups"))
    ranked = running_sums(sized, "size", ["k"], by).withColumn("rank", F.col("k_sum") - (F.col("k") - 1) / 2)
    k, m = F.col("k").cast("double"), F.col("m").cast("double")  # cubes of counts go beyond 64 bits
    sums = ranked.groupBy(*[F.col(c).alias(f"_w_{c}") for c in by]).agg(F.sum(F.col("ups") * F.col("rank")).alias("w"), F.sum("k").alias("m"), F.sum(k * k * k - k).alias("_ties"))
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in by], F.lit(True))
    both = tested.join(sums, on, "left").withColumn("m", F.coalesce("m", F.lit(0)))
    z = (F.col("w") - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties") / 48)
    p_w = F.when((F.col("_ties") == 0) & (m <= 50), probability.signed_rank_two_sided(F.col("w"), m)).otherwise(probability.normal_two_sided(z))
    return both.withColumn("p_w", p_w).select(*by, "n", "mean_difference", "t", "p_t", "m", F.coalesce("w", F.lit(0.0)).alias("w"), "p_w")


def ks_tests(rows: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(…by, statistic, n_a, n_b, p): two-sample Kolmogorov-Smirnov tests, p by the limit distribution; `group` is boolean, true for a.

    A group with one sample only has no statistic.
    """
    g = F.col(group).cast("int")
    counts = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, value).agg(F.sum(g).alias("a"), F.sum(1 - g).alias("b"))
    c = running_sums(counts, value, ["a", "b"], by)
    d = c.select(*by, F.abs(F.try_divide("a_sum", "a_all") - F.try_divide("b_sum", "b_all")).alias("d"), "a", "b")
    out = d.groupBy(*by).agg(F.max("d").alias("statistic"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    return out.withColumn("p", probability.ks_two_sided(F.col("statistic"), F.col("n_a"), F.col("n_b")))


def first_values(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(stay_id, …keys, value): the first value that isn't null; of several at one time the smallest."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(ID, *keys).agg(F.min_by(value, F.struct(TIME, value)).alias(value))


def ks_two_sample(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Largest distance of the two groups' distribution functions; `group` is boolean."""
    g = F.col(group).cast("int")
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(g).alias("a"), F.sum(1 - g).alias("b"))
    c = running_sums(counts, value, ["a", "b"])
    d = c.select(F.abs(F.col("a_sum") / F.col("a_all") - F.col("b_sum") / F.col("b_all")).alias("d"), "a", "b")
    return d.agg(F.max("d").alias("statistic"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def attribution(rows: DataFrame, by: Sequence[str] = ("run",), hours: int | None = None) -> DataFrame:
    """(…by, feature, mean_abs, largest, rank): mean size and signed largest of attributions, ranked by the mean (equal ones share the lowest rank)."""
    if hours is not None:
        last = F.max(TIME).over(Window.partitionBy(*by, ID))
        rows = rows.withColumn("_last", last).where(F.col(TIME) > F.col("_last") - hours)
    per = rows.groupBy(*by, "feature").agg(F.avg(F.abs("shap")).alias("mean_abs"), F.max_by("shap", F.struct(F.abs("shap"), F.col("shap"))).alias("largest"))
    return per.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("mean_abs"))))


def top_features(ranks: DataFrame, k: int = 20) -> DataFrame:
    """Mean rank and mean size of each feature over runs; the k best."""
    return ranks.groupBy("feature").agg(F.avg("rank").alias("mean_rank"), F.avg("mean_abs").alias("mean_abs"), F.stddev_samp("mean_abs").alias("std_abs")).orderBy("mean_rank", "feature").limit(k)


def keep_last(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group in the given order."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")
