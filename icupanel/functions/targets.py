"""Time-dependent utility, objectives and prevalence weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icupanel.operators.panel import ID, add_onset


def utility(prediction: Column, k: Column, weight: Column | float = 1.0, early: int = -12, best: int = -6, late: int = 3, false_alarm: float = -0.05, missed: float = -2.0) -> Column:
    """Utility of one hourly prediction; `k` is the row's distance to onset, null for controls; a null prediction is worth 0."""
    rise, fall, drop = 1 / (best - early), 1 / (late - best), missed / (late - best)
    alarm = F.when(k <= best, F.greatest((k - early) * rise, F.lit(false_alarm))).when(k <= late, (late - k) * fall).otherwise(0.0)
    silence = F.when(k <= best, 0.0).when(k <= late, (k - best) * drop).otherwise(0.0)
    case = F.when(prediction == 1, alarm).otherwise(silence) * weight
    control = F.when(prediction == 1, false_alarm).otherwise(0.0)
    return F.when(prediction.isNull(), 0.0).when(k.isNotNull(), case).otherwise(control)


def with_utilities(panel: DataFrame, label: str = "sep3", shift: int = 0, **options) -> DataFrame:
    """`panel` with u1 and u0, the utilities of predicting 1 and 0, and utility, their difference."""
    out = panel if "onset_position" in panel.columns else add_onset(panel, label)
    k = F.col("position") - (F.col("onset_position") + shift)
    return out.withColumn("u1", utility(F.lit(1), k, **options)).withColumn("u0", utility(F.lit(0), k, **options)).withColumn("utility", F.col("u1") - F.col("u0"))


def normalised_utility(panel: DataFrame, prediction: str, label: str = "sep3", shift: int = 0, weight: float = 1.0) -> DataFrame:
    """One row: observed, best and inaction utility and (observed - inaction) / (best - inaction)."""
    out = panel if "onset_position" in panel.columns else add_onset(panel, label)
    k, onset = F.col("position") - (F.col("onset_position") + shift), F.col("onset_position") + shift
    n = F.count("*").over(_stay())
    ideal = F.when(onset.isNotNull() & F.col("position").between(F.greatest(onset - 12, F.lit(0)), F.least(onset + 3, n - 1)), 1).otherwise(0)
    known = F.col(prediction).isNotNull()
    sums = out.withColumn("_best", ideal).select(
        utility(F.col(prediction), k, weight).alias("o"), utility(F.when(known, F.col("_best")), k, weight).alias("b"), utility(F.when(known, F.lit(0)), k, weight).alias("i"))
    total = sums.agg(F.sum("o").alias("observed"), F.sum("b").alias("best"), F.sum("i").alias("inaction"))
    return total.withColumn("normalised", F.try_divide(F.col("observed") - F.col("inaction"), F.col("best") - F.col("inaction")))


def _stay():
    from pyspark.sql import Window

    return Window.partitionBy(ID)


def lambda_sums(panel: DataFrame, label: str = "sep3", early: int = 12) -> DataFrame:
    """One row a stay: t_neg (rows of controls), t_pos (early rows of cases), g and h (their utilities), over the complete grid."""
    out = with_utilities(panel, label)
    known = F.col(label).isNotNull()
    per = out.groupBy(ID).agg(
        F.max(F.col("is_case").cast("int")).alias("case"), F.count("*").alias("n"), F.max("onset_position").alias("onset"),
        F.sum(F.when(known, F.greatest("u1", F.lit(0.0))).otherwise(0.0)).alias("g"), F.sum(F.when(known, F.col("u0")).otherwise(0.0)).alias("h"))
    case = F.col("case") == 1
    return per.select(
        ID, "case", F.when(case, 0).otherwise(F.col("n")).alias("t_neg"), F.when(case, F.greatest(F.col("onset") - early, F.lit(0))).otherwise(0).alias("t_pos"),
        F.when(case, F.col("g")).otherwise(0.0).alias("g"), F.when(case, F.col("h")).otherwise(0.0).alias("h"))


def lambda_weight(panel: DataFrame, label: str = "sep3", cost: float = 1, false_alarm: float = -0.05) -> DataFrame:
    """One row: lam, which makes the rewards of cases and the costs of controls balance, and the prevalence."""
    s = lambda_sums(panel, label).agg(*[F.sum(c).alias(c) for c in ("t_neg", "t_pos", "g", "h")], F.avg("case").alias("prevalence"))
    u = -false_alarm
    return s.select((u * F.col("t_neg") / ((cost + 1) * (F.col("g") - F.col("h")) - u * F.col("t_pos"))).alias("lam"), "prevalence")


def weighted(target: Column, is_case: Column, lam: Column | float) -> Column:
    return F.when(is_case, target * lam).otherwise(target)


def objectives(delta: Column) -> dict[str, Column]:
    """Piecewise objectives of the hours since onset (null: control): alarm, silence, their difference and the better."""
    alarm = F.when(delta.isNull() | (delta < -12), -0.05).when(delta <= -6, (delta + 12) / 6).when(delta <= 3, 1 - (delta + 6) / 9).otherwise(0.0)
    silence = F.when(delta.isNull() | (delta <= -6), 0.0).when(delta <= 3, -2 * (delta + 6) / 9).otherwise(0.0)
    return {"phys_pos": alarm, "phys_neg": silence, "phys_cum": alarm - silence, "phys_opt": F.greatest(alarm, silence)}


def class_objective(delta: Column, left: float = -6, right: float | None = None) -> Column:
    inside = delta >= left if right is None else delta.between(left, right)
    return F.coalesce(inside, F.lit(False)).cast("int")


def ramp_objective(delta: Column, left: float = -12, mid: float = -6, right: float = 6, outside: float = -0.05) -> Column:
    return (
        F.when(delta.isNull() | (delta < left), outside).when(delta < mid, (delta - left) / (mid - left)).when(delta == mid, 1.0)
        .when(delta <= right, 1 - (delta - mid) / (right - mid)).otherwise(0.0))
