"""From concept tables to complete hourly panels, onsets and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icupanel.functions.windows import by_stay, position

ID, TIME = "stay_id", "stay_time"


def to_concepts(events: DataFrame, id: str, ts: str, concept: str, value: str, seconds: int = 3600) -> DataFrame:
    """Long (stay_id, stay_time, concept, value); stay_time counts whole hours from the stay's first event.

    The rows are dealt by stay, which serves all that goes stay by stay later.
    """
    rows = dealt_by_stay(events.where(F.col(id).isNotNull()).select(F.col(id).alias(ID), F.col(ts).alias("_ts"), F.col(concept).alias("concept"), F.col(value).alias("value")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = F.floor((micros("_ts") - micros("_t0")) / (seconds * 1_000_000))
    return rows.withColumn("_t0", F.min("_ts").over(Window.partitionBy(ID))).select(ID, hours.cast("long").alias(TIME), "concept", "value")


def dealt_by_stay(rows: DataFrame) -> DataFrame:
    """`rows` dealt by stay over as many partitions as shuffles have, a number that isn't merged by size: a panel has many more rows than were shuffled for it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ID)


def stay_bounds(rows: DataFrame) -> DataFrame:
    """First and last time of each stay."""
    return rows.groupBy(ID).agg(F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time"))


def complete_grid(rows: DataFrame, step: int = 1, carried: Sequence[str] = ()) -> DataFrame:
    """Every time from each stay's first to its last, with the rows' columns; missing rows are null but for the `carried` columns, which keep the row's before.

    Each row is spread up to the next one of its stay, so the grid is neither
    joined nor shuffled: only `rows` are.
    """
    stay, columns = Window.partitionBy(ID), [c for c in rows.columns if c not in (ID, TIME)]
    placed = rows.where(F.col(TIME).isNotNull()).withColumn("_first", F.min(TIME).over(stay.orderBy(TIME).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    placed = placed.withColumn("_last", F.max(TIME).over(stay.orderBy(TIME).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    if step != 1:
        placed = placed.where((F.col(TIME) - F.col("_first")) % step == 0)
    end = F.coalesce(F.lead(TIME).over(stay.orderBy(TIME)), F.col("_last") + 1)
    # rows without a stay meet no time, so they count once and without values
    placed = placed.withColumn("_end", end).where(F.col(ID).isNotNull() | (F.col("_end") > F.col(TIME)))
    until = F.greatest(F.col(TIME), F.col("_end") - 1).cast("long")
    own = (F.col("_at") == F.col(TIME)) & F.col(ID).isNotNull()
    spread = placed.select(ID, TIME, *columns, F.explode(F.sequence(F.col(TIME).cast("long"), until, F.lit(step).cast("long"))).alias("_at"))
    return spread.select(ID, F.col("_at").alias(TIME), *[F.when(F.col(ID).isNotNull() if c in carried else own, F.col(c)).alias(c) for c in columns])


def to_panel(concepts: DataFrame, names: dict[str, str], grid: bool = True) -> DataFrame:
    """Wide hourly panel: mean of each concept's values under its column name.

    One shuffle by (stay, hour) folds all concepts at once; naming the concepts
    spares the pass that a pivot would need to find them.
    """
    wide = concepts.groupBy(ID, TIME).pivot("concept", list(names)).agg(F.avg("value"))
    wide = wide.withColumnsRenamed(names)
    return complete_grid(wide) if grid else wide


def onset_time(label: str = "sep3") -> Column:
    return F.min(F.when(F.col(label) == 1, F.col(TIME))).over(Window.partitionBy(ID))


def add_onset(panel: DataFrame, label: str = "sep3") -> DataFrame:
    """onset (time of the first label 1), onset_delta, onset_position and is_case."""
    out = panel.withColumn("position", position()).withColumn("onset", onset_time(label))
    first = F.min(F.when(F.col(label) == 1, F.col("position"))).over(Window.partitionBy(ID))
    return out.withColumn("onset_delta", F.col(TIME) - F.col("onset")).withColumn("onset_position", first).withColumn("is_case", F.col("onset").isNotNull())


def shift_label(panel: DataFrame, left: int = 6, right: int = 24, label: str = "sep3", to: str = "shifted") -> DataFrame:
    """Label 1 from `left` hours before onset to `right` after, 0 elsewhere; null stays null and controls are untouched."""
    onset = onset_time(label)
    inside = F.col(TIME).between(onset - left, onset + right)
    return panel.withColumn(to, F.when(F.col(label).isNull(), None).when(onset.isNull(), F.col(label)).when(inside, 1.0).otherwise(0.0).cast("double"))


def onset_violations(panel: DataFrame, label: str = "sep3") -> DataFrame:
    """Rows where a case's label returns to 0 after its onset."""
    return panel.withColumn("onset", onset_time(label)).where((F.col(TIME) > F.col("onset")) & (F.col(label) == 0)).select(ID, TIME, label)


def value_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(stay_id, column, n): null or not-a-number values where none may be."""
    counts = rows.groupBy(ID).agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns])
    return counts.unpivot(ID, list(columns), "column", "n").where("n > 0")


def alignment_violations(a: DataFrame, b: DataFrame, keys: Sequence[str] = (ID, TIME)) -> DataFrame:
    """Keys of only one of two tables, with the side that has them."""
    sides = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    met = sides.groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return met.where("in_a <> in_b").select(*keys, F.when(F.col("in_a") == 1, "a").otherwise("b").alias("only_in"))


def checked(violations: DataFrame, what: str) -> None:
    n = violations.limit(1).count()
    if n:
        raise ValueError(f"{what}: {violations.first()}")


def label_locf(panel: DataFrame, label: str = "sep3") -> DataFrame:
    held = F.last(label, ignorenulls=True).over(by_stay().rowsBetween(Window.unboundedPreceding, 0))
    return panel.withColumn(label, F.coalesce(held, F.lit(0.0)))


def challenge_onset(rows: DataFrame, label: str, hour: str, lead: int = 6) -> DataFrame:
    """(stay_id, onset): first labelled hour plus `lead`, times counted from 0."""
    return rows.groupBy(ID).agg((F.min(F.when(F.col(label) == 1, F.col(hour))) - 1 + lead).alias("onset"))


def interval_hours(intervals: DataFrame, start: str, stop: str, keys: Sequence[str] = (ID,)) -> DataFrame:
    """One row for each whole hour of each interval, both ends included."""
    fit = intervals.where(F.col(start) <= F.col(stop))
    return fit.select(*keys, F.explode(F.sequence(F.floor(start), F.floor(stop))).alias(TIME)).distinct()


def to_resolution(time: Column, step: float) -> Column:
    return F.floor(time / step) * step


def instances(panel: DataFrame, columns: Sequence[str], length: int | None = None, pad: float | None = None) -> DataFrame:
    """One row a stay: its times and columns as arrays in time order, padded to `length`."""
    gathered = panel.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct(TIME, *columns))).alias("rows"))

    def column(c: str) -> Column:
        values = F.transform("rows", lambda r: r[c])
        if length is None:
            return values
        fill = F.lit(pad).cast("double") if c != TIME else F.lit(None).cast("long")
        return F.concat(values, F.array_repeat(fill, F.greatest(F.lit(0), F.lit(length) - F.size(values))))

    return gathered.select(ID, F.size("rows").alias("length"), *[column(c).alias(f"{c}s" if c == TIME else c) for c in (TIME, *columns)])


def prefixes(panel: DataFrame, column: str) -> DataFrame:
    """For each row of a stay, the values up to it: what an online model may see."""
    seen = F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))).over(by_stay().rowsBetween(Window.unboundedPreceding, 0))
    return panel.select(ID, TIME, seen.alias("seen"))


def order_violations(rows: DataFrame) -> DataFrame:
    """Rows less than one hour after the row before."""
    gap = F.col(TIME) - F.lag(TIME).over(by_stay())
    return rows.withColumn("gap", gap).where("gap < 1").select(ID, TIME, "gap")
