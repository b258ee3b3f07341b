"""Cohort definitions: filters, attrition, interval and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icupanel.functions.windows import by_stay

ID, TIME = "stay_id", "stay_time"


def in_stay_only(panel: DataFrame) -> DataFrame:
    return panel.where(F.col(TIME) >= 0)


def observed_rows(panel: DataFrame, columns: Sequence[str], label: str = "sep3", least: int = 1) -> DataFrame:
    """Rows with at least `least` values and a label."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return panel.where((n >= least) & F.col(label).isNotNull())


def onset_bounds(panel: DataFrame, low: int = 3, high: int = 168) -> DataFrame:
    """Drops cases whose onset position isn't in (low, high]; needs `add_onset`."""
    return panel.where(F.col("onset_position").isNull() | ((F.col("onset_position") > low) & (F.col("onset_position") <= high)))


def truncate_cases(panel: DataFrame, after: int = 24, high: int = 168) -> DataFrame:
    """Cases up to `after` rows past onset, controls up to `after` + `high` hours; needs `add_onset`."""
    return panel.where(F.when(F.col("onset_position").isNotNull(), F.col("position") <= F.col("onset_position") + after).otherwise(F.col(TIME) <= after + high))


def cut_time(onset: Column, out: Column, after: int = 24, most: int = 192) -> Column:
    return F.when(onset.isNotNull(), onset + after).otherwise(F.least(out, F.lit(most)))


def truncate_to_window(rows: DataFrame, windows: DataFrame, lower: int = -48, upper: str = "cuttime") -> DataFrame:
    """Rows of each stay between `lower` and its window's upper time."""
    w = windows.select(F.col(ID).alias("_id"), F.col(upper).alias("_upper"))
    return rows.join(w, (F.col(ID) == F.col("_id")) & (F.col(TIME) <= F.col("_upper"))).where(F.col(TIME) >= lower).drop("_id", "_upper")


def enough_measurements(panel: DataFrame, columns: Sequence[str], least: int = 4) -> DataFrame:
    """Ids with at least `least` in-stay hours that hold a value."""
    any_value = F.greatest(*[F.col(c).isNotNull().cast("int") for c in columns], F.lit(0)) == 1
    return panel.where((F.col(TIME) >= 0) & any_value).groupBy(ID).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(ID)


def missing_runs(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(stay_id, run_start, run_length) of consecutive rows without any value."""
    empty = ~F.greatest(*[F.col(c).isNotNull() for c in columns], F.lit(False))
    island = F.row_number().over(by_stay()) - F.row_number().over(Window.partitionBy(ID, "_empty").orderBy(TIME))
    rows = panel.withColumn("_empty", empty).withColumn("_island", island)
    return rows.where("_empty").groupBy(ID, "_island").agg(F.min(TIME).alias("run_start"), F.count("*").alias("run_length")).drop("_island")


def without_long_gaps(panel: DataFrame, columns: Sequence[str], most: int = 12) -> DataFrame:
    gone = missing_runs(panel.where(F.col(TIME) > 0), columns).where(F.col("run_length") > most).select(ID).distinct()
    return panel.join(gone, ID, "left_anti")


def attrition(stays: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, name, remaining): stays left after each filter, all counted in one pass."""
    held, sums = F.lit(True), [F.count("*").alias("s0")]
    for k, (_, condition) in enumerate(steps, 1):
        held = held & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(held).alias(f"s{k}"))
    names = ["all", *(n for n, _ in steps)]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), F.col(f"s{k}").alias("remaining")) for k, n in enumerate(names)]))
    return stays.agg(*sums).select(rows.alias("r")).select("r.*")


def site_prevalence(stays: DataFrame, site: str, case: str = "is_case") -> DataFrame:
    return stays.groupBy(site).agg(F.count("*").alias("stays"), F.avg(F.col(case).cast("double")).alias("prevalence"))


def prevalent_sites(stays: DataFrame, site: str, least: float = 0.15, case: str = "is_case") -> DataFrame:
    return stays.join(site_prevalence(stays, site, case).where(F.col("prevalence") >= least).select(site), site, "left_semi")


def site_sweep(stays: DataFrame, site: str, thresholds: Sequence[float], case: str = "is_case") -> DataFrame:
    """Stays and cases that each prevalence threshold would keep: sites are few, thresholds a literal array."""
    sites = stays.groupBy(site).agg(F.count("*").alias("n"), F.sum(F.col(case).cast("long")).alias("cases"))
    each = sites.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    keep = F.col("cases") / F.col("n") >= F.col("threshold")
    return each.groupBy("threshold").agg(
        F.sum(F.when(keep, F.col("n")).otherwise(0)).alias("stays"), F.sum(F.when(keep, F.col("cases")).otherwise(0)).alias("cases"), F.count_if(keep).alias("sites"))


def interval_onset(scores: DataFrame, suspicion: DataFrame, before: int = 48, after: int = 24, rise: float = 2, score: str = "sofa", si: str = "si_time") -> DataFrame:
    """First score row per stay that rises by `rise` above the least before it inside a suspicion window."""
    s = suspicion.select(F.col(ID).alias("_id"), F.col(si).alias("si_time")).distinct()
    inside = scores.join(s, (F.col(ID) == F.col("_id")) & F.col(TIME).between(F.col("si_time") - before, F.col("si_time") + after)).drop("_id")
    w = Window.partitionBy(ID, "si_time").orderBy(TIME)
    risen = inside.withColumn("delta", F.col(score) - F.min(score).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("delta") >= rise)
    return risen.groupBy(ID).agg(F.min(F.struct("si_time", TIME, "delta")).alias("r")).select(ID, "r.si_time", F.col(f"r.{TIME}").alias("onset"), "r.delta")


def abx_counts(abx: DataFrame, time: str = "abx_time", hours: int = 24, least: int = 1) -> DataFrame:
    """Antibiotic times followed by at least `least` of them within `hours`, themselves included."""
    w = Window.partitionBy(ID).orderBy(F.col(time)).rangeBetween(0, hours)
    return abx.withColumn("in_window", F.count("*").over(w)).where(F.col("in_window") >= least)


def suspicion(abx: DataFrame, samples: DataFrame, abx_after: int = 72, sample_after: int = 24, mode: str = "and") -> DataFrame:
    """(stay_id, abx_time, samp_time, si_time) of suspected infections.

    `and`: a sample followed by an antibiotic within `abx_after` hours, or an
    antibiotic followed by a sample within `sample_after`; si_time is the
    earlier.  `or`: every antibiotic and sample by itself.
    """
    if mode == "or":
        a = abx.select(ID, F.col("abx_time"), F.lit(None).cast("long").alias("samp_time"), F.col("abx_time").alias("si_time"))
        return a.unionByName(samples.select(ID, F.lit(None).cast("long").alias("abx_time"), "samp_time", F.col("samp_time").alias("si_time"))).distinct()
    s = samples.select(F.col(ID).alias("_id"), "samp_time")
    met = abx.join(s, (F.col(ID) == F.col("_id")) & (F.col("abx_time") - F.col("samp_time")).between(-sample_after, abx_after))
    return met.select(ID, "abx_time", "samp_time", F.least("abx_time", "samp_time").alias("si_time")).distinct()


def next_event(rows: DataFrame, events: DataFrame, at: str, time: str, strict: bool = True, to: str = "next_time") -> DataFrame:
    """As-of join forward: the first of `events` after each row's time, null without one; repeated rows stay.

    Rows and events of a stay stand in one order, latest first, so that one
    running minimum gives each row its next event.
    """
    mine = rows.select(F.col(ID).alias("_id"), F.col(at).alias("_at"), F.lit(None).cast(events.schema[time].dataType).alias("_t"), F.lit(2 if strict else 0).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    theirs = events.select(F.col(ID).alias("_id"), F.col(time).alias("_at"), F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    seen = Window.partitionBy("_id").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("_id").isNotNull() & F.col("_at").isNotNull()
    met = mine.unionByName(theirs).withColumn("_next", F.when(known, F.min("_t").over(seen)))
    return met.where(F.col("_kind") != 1).select("_row.*", F.col("_next").alias(to))


def compare_first(a: DataFrame, b: DataFrame, time: str) -> DataFrame:
    """First times per stay by two definitions, side by side, with who has them."""
    first = lambda d, n: d.groupBy(ID).agg(F.min(time).alias(n))
    both = first(a, "time_a").join(first(b, "time_b"), ID, "full")
    where = F.when(F.col("time_b").isNull(), "a").when(F.col("time_a").isNull(), "b").otherwise("both")
    return both.withColumn("found_by", where).withColumn("difference", F.col("time_b") - F.col("time_a"))


def known_time(onset: Column, *others: Column) -> Column:
    """When a label could be known: the latest of its parts' times."""
    return F.greatest(onset, *others)


def time_class(onset: Column, sample: Column, abx: Column) -> Column:
    """How many of sampling and antibiotic came before or with the onset."""
    return F.coalesce((sample <= onset).cast("int"), F.lit(0)) + F.coalesce((abx <= onset).cast("int"), F.lit(0))
