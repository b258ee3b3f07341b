"""Stratified splits, folds and subsamples by deterministic hash ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icupanel.operators.ordered import hash_ranks

ID = "stay_id"


HASH_BITS = 52


def hash_key(id: Column, seed: Column | int) -> Column:
    """The first 52 bits of the MD5 of seed and id: any SQL engine can repeat it, and another seed gives another order."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), id.cast("string"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(stays: DataFrame, seed: Column | int, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """`stays` with r, the rank of their hash within `by`, and n, the number there."""
    return hash_ranks(stays, hash_key(F.col(ID), seed), ID, by, bits=HASH_BITS)


def stratified_split(stays: DataFrame, test: float = 0.1, reps: int = 5, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """(stay_id, label, rep, split): one test set, and in each rep a validation share of all stays from the rest; per label, counts rounded up."""
    dealt = ranked(stays.select(ID, "label"), seed)
    held = dealt.select(ID, "label", (F.col("r") <= F.ceil(F.col("n") * test)).alias("test"), F.ceil(F.col("n") * validation).alias("size"))
    each = held.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    each = ranked(each, F.col("rep") + 1, ("label", "rep", "test"))
    part = F.when(F.col("test"), "test").when(F.col("r") <= F.col("size"), "validation").otherwise("train")
    return each.select(ID, "label", "rep", part.alias("split"))


def test_boosts(splits: DataFrame, share: float = 0.8, seed: int = 7) -> DataFrame:
    """Per rep, a stratified `share` of the test stays."""
    t = ranked(splits.where(F.col("split") == "test"), F.col("rep") + seed, ("label", "rep"))
    return t.where(F.col("r") <= F.ceil(F.col("n") * share)).drop("r", "n")


def folds(stays: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    return ranked(stays.select(ID, "label"), seed).select(ID, "label", ((F.col("r") - 1) % k).cast("int").alias("fold"))


def fine_tuning_subsets(splits: DataFrame, shares: tuple[float, ...] = (0.2, 0.5), seed: int = 3) -> DataFrame:
    """(stay_id, label, rep, share): nested stratified shares of the validation stays."""
    v = ranked(splits.where(F.col("split") == "validation"), seed, ("label", "rep"))
    each = v.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return each.where(F.col("r") <= F.ceil(F.col("n") * F.col("share"))).select(ID, "label", "rep", "share")


def training_subsets(splits: DataFrame, sizes: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5), train_share: float = 0.8, rep: int = 0, seed: int = 4) -> DataFrame:
    """(stay_id, label, size): nested stratified parts of one repetition's training stays, `size` of all development stays each, of which training makes up `train_share`."""
    t = ranked(splits.where((F.col("split") == "train") & (F.col("rep") == rep)).select(ID, "label"), seed)
    each = t.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return each.where(F.col("r") <= F.ceil(F.round(F.col("n") * F.col("size") / train_share, 9))).select(ID, "label", "size")


def resplit(splits: DataFrame, train: tuple[float, ...] = (0.9, 0.7), seed: int = 6) -> DataFrame:
    """(stay_id, label, rep, share, split): each repetition's validation stays parted anew into training and validation, such as 90 to 10 and 70 to 30."""
    v = ranked(splits.where(F.col("split") == "validation").select(ID, "label", "rep"), F.col("rep") + seed, ("label", "rep"))
    each = v.withColumn("share", F.explode(F.array(*[F.lit(s) for s in train])))
    part = F.when(F.col("r") <= F.floor(F.round(F.col("n") * F.col("share"), 9)), "train").otherwise("validation")
    return each.select(ID, "label", "rep", "share", part.alias("split"))


def subsample(stays: DataFrame, prevalence: float = 0.188, draws: int = 10, seed: int = 123) -> DataFrame:
    """(draw, stay_id, label): the over-represented class drawn down to the target prevalence, the other whole."""
    p = prevalence
    counts = stays.agg(F.count_if(F.col("label") == 1).alias("cases"), F.count_if(F.col("label") == 0).alias("controls")).first()
    cases, controls = counts.cases, counts.controls
    over = 1 if cases / max(1, cases + controls) > p else 0
    size = round(controls * p / (1 - p)) if over else round(cases * (1 - p) / p)
    each = stays.select(ID, "label").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return ranked(each, F.col("draw") + seed, ("draw", "label")).where((F.col("label") != over) | (F.col("r") <= size)).select("draw", ID, "label")


def resample_controls(stays: DataFrame, case_share: float, seed: int = 5) -> DataFrame:
    """(unit_id, stay_id, label): controls repeated or thinned until cases make up `case_share`."""
    row = stays.agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).first()
    want = round(row.a * (1 - case_share) / case_share)
    times, rest = divmod(want, max(1, row.b))
    n = F.when(F.col("label") == 1, 1).otherwise(times + (F.col("r") <= rest).cast("int"))
    each = ranked(stays.select(ID, "label"), seed).withColumn("n", n).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select(F.concat_ws("_", ID, "copy").alias("unit_id"), ID, "label")


def bootstrap_draws(stays: DataFrame, draws: int, seed: int = 11, by: tuple[str, ...] = ()) -> DataFrame:
    """(…by, draw, stay_id, times): each draw takes as many stays as there are, with replacement; stays that a draw misses have no row in it.

    With `by`, every stratum is drawn from for itself.  Place j of a draw takes
    the stay whose rank in its stratum is a hash of seed, draw and j, so the
    multiplicities are multinomial; only picks, two numbers each, are counted,
    and they meet the stays by rank.  Null stay ids aren't drawn.
    """
    known = stays.where(F.col(ID).isNotNull()).select(*by, ID).distinct()
    placed = ranked(known, seed, by)  # r from 1 to n in each stratum
    each = placed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = F.pmod(hash_key(F.concat_ws("|", *[F.col(c).cast("string") for c in ("draw", "r", *by)]), seed + 1), F.col("n")) + 1
    picks = each.groupBy(*[F.col(c).alias(f"_p_{c}") for c in by], "draw", pick.alias("_rank")).agg(F.count("*").alias("times"))
    on = F.col("_rank") == F.col("r")
    for c in by:
        on = on & F.col(f"_p_{c}").eqNullSafe(F.col(c))
    return placed.join(picks, on).select(*by, "draw", ID, "times")


def bootstrap_units(draws: DataFrame) -> DataFrame:
    """Draws as (unit_id, draw, stay_id), a unit for each time a stay was taken, for `bootstrap`."""
    copies = draws.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select(F.concat_ws("_", "draw", ID, "copy").alias("unit_id"), "draw", ID)


def bootstrap_means(values: DataFrame, draws: DataFrame, columns: list[str]) -> DataFrame:
    """(draw, n, …columns): the means of stay-level values in each draw, weighted by multiplicity; no stay is repeated."""
    met = draws.select("draw", F.col(ID).alias("_id"), "times").join(values, F.col("_id") == F.col(ID))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("times")), F.sum(F.when(F.col(c).isNotNull(), F.col("times"))))
    return met.groupBy("draw").agg(F.sum("times").alias("n"), *[mean(c).alias(c) for c in columns])


def bootstrap(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """Rows repeated once for each draw of their stay, under the draw's own unit_id."""
    return rows.join(draws.select("unit_id", F.col(ID).alias("_id")).hint("shuffle_hash"), F.col("_id") == F.col(ID)).select("unit_id", *rows.columns)


def split_checks(splits: DataFrame) -> DataFrame:
    """(rep, split, stays, cases, prevalence, shared): shared counts stays that another split of the rep holds too."""
    parts = F.count("*").over(Window.partitionBy("rep", ID))
    return splits.withColumn("parts", parts).groupBy("rep", "split").agg(
        F.count("*").alias("stays"), F.sum("label").alias("cases"), F.avg("label").alias("prevalence"), F.count_if(F.col("parts") > 1).alias("shared"))
