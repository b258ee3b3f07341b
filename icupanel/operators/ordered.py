"""Running sums and ranks over whole tables without gathering them in one task.

Rows are dealt into ordered buckets; sums of the buckets, a bounded table, give
each bucket what comes before it, and windows run inside the buckets only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(dealt: DataFrame, by: Sequence[str], sums: dict[str, Column], descending: bool) -> DataFrame:
    own = dealt.groupBy(*by, "_bucket").agg(*[c.alias(f"_s_{n}") for n, c in sums.items()])
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row a bucket
    before = w.orderBy(F.desc("_bucket") if descending else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums] + [F.sum(f"_s_{n}").over(w).alias(f"_all_{n}") for n in sums]
    return own.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_bucket").alias("_k"), *cols)


def _met(dealt: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    on = F.col("_bucket") == F.col("_k")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return dealt.join(F.broadcast(offsets) if not by else offsets, on).drop("_k", *[f"_k_{c}" for c in by])


def bucketed(df: DataFrame, order: str, by: Sequence[str], buckets: int, sample: int = 4096) -> DataFrame:
    """`df` with `_bucket`, rising with `order` within `by`.

    The cuts come from at most `sample` values a group, in each class of a hash the
    one with the least hash.  They depend on the values alone: the plan is run
    for the buckets' sums and once more for the rows, and approximate
    quantiles, which change with the order in which parts arrive, would deal rows otherwise there.
    """
    hash_ = F.xxhash64(F.col(order).cast("double"), F.lit(7))
    slot = F.pmod(F.xxhash64(F.col(order).cast("double")), F.lit(sample))
    one = df.where(F.col(order).isNotNull()).groupBy(*by, slot.alias("_slot")).agg(F.min_by(F.col(order).cast("double"), hash_).alias("_v"))
    drawn = one.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    place = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda k: F.get("_all", F.floor(k * F.size("_all") / buckets).cast("int")))
    cuts = drawn.select(*[F.col(c).alias(f"_c_{c}") for c in by], place.alias("_cuts"))
    if by:
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in by])
        dealt = df.join(cuts, on).drop(*[f"_c_{c}" for c in by])
    else:
        known = cuts.first()
        dealt = df.withColumn("_cuts", F.array(*[F.lit(float(c)) for c in sorted(set(known._cuts if known else []))]).cast("array<double>"))
    return dealt.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")


def running_sums(df: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = (), descending: bool = False, buckets: int = 64) -> DataFrame:
    """`df` with `<column>_sum` (over this and all rows before it) and `<column>_all`; `order` is numeric and distinct within `by`.

    Buckets are cut at quantiles of a sample of `order`, so they hold about the
    same number of rows whatever the distribution.
    """
    dealt = bucketed(df, order, by, buckets)
    offsets = _offsets(dealt, by, {c: F.sum(c) for c in columns}, descending)
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = _met(dealt, offsets, by)
    out = out.withColumns({f"{c}_sum": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in columns} | {f"{c}_all": F.col(f"_all_{c}") for c in columns})
    return out.drop("_bucket", *[f"_before_{c}" for c in columns], *[f"_all_{c}" for c in columns])


def hash_ranks(df: DataFrame, key: Column, tie: str, by: Sequence[str], rank: str = "r", total: str = "n", bits: int = 31, buckets: int = 1024) -> DataFrame:
    """`df` with each row's rank by a uniform hash of `bits` bits (ties by `tie`) and the number of rows, within `by`."""
    dealt = df.withColumn("_key", key).withColumn("_bucket", F.floor(F.col("_key") / ((1 << bits) // buckets)).cast("int"))
    offsets = _offsets(dealt, by, {"n": F.count("*")}, descending=False)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", tie)
    out = _met(dealt, offsets, by)
    return out.withColumn(rank, F.col("_before_n") + F.row_number().over(inside)).withColumn(total, F.col("_all_n")).drop("_key", "_bucket", "_before_n", "_all_n")
