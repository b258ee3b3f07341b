"""Scoring predictions against labels hour by hour, however gappy: checks, alignment, shift and score in one chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icupanel.functions import targets
from icupanel.operators import panel as P

ID, TIME = P.ID, P.TIME


def _checked(column: str) -> Column:
    """The column, or an error while the job runs where it is null or not a number."""
    value = F.col(column).cast("double")
    said = F.concat(F.lit(f"{column} is missing for stay "), F.coalesce(F.col(ID).cast("string"), F.lit("null")), F.lit(" at "), F.coalesce(F.col(TIME).cast("string"), F.lit("null")))
    return F.when(value.isNull() | F.isnan(value), F.raise_error(said).cast("double")).otherwise(value)


def aligned(labels: DataFrame, predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(stay_id, stay_time, label, prediction) over every hour from a stay's first to its last prediction; null in hours without a row.

    Labels and predictions must have the same (stay, time) keys and no missing
    values; whatever breaks this raises an error when the rows are computed, on
    the executors, so nothing is scanned twice.  Stays with no row on either
    side are absent; an empty input gives no rows.
    """
    left = labels.select(ID, TIME, _checked(label).alias("label"))
    right = predictions.select(F.col(ID).alias("_id"), F.col(TIME).alias("_time"), _checked(prediction).alias("prediction"))
    met = left.join(right, F.col(ID).eqNullSafe(F.col("_id")) & F.col(TIME).eqNullSafe(F.col("_time")), "full")
    said = F.concat(F.lit("labels and predictions aren't aligned: stay "), F.coalesce(F.col(ID), F.col("_id")).cast("string"), F.lit(" at "), F.coalesce(F.col(TIME), F.col("_time")).cast("string"))
    whole = F.when(F.col("label").isNull() | F.col("prediction").isNull(), F.raise_error(said).cast("double")).otherwise(F.col("label"))
    rows = met.select(F.coalesce(F.col(ID), F.col("_id")).alias(ID), F.coalesce(F.col(TIME), F.col("_time")).alias(TIME), whole.alias("label"), "prediction")
    return P.complete_grid(rows)


def online_score(
    labels: DataFrame, predictions: DataFrame, score: Callable[..., DataFrame] = targets.normalised_utility, label: str = "label", prediction: str = "prediction", shift_left: int = 0, shift_right: int = 24, **options
) -> DataFrame:
    """`score` of predictions against labels, aligned, made consecutive and with the labels' onset moved `shift_left` hours forward.

    A label that falls back to 0 after its onset raises an error.  `score` takes
    the rows and the names of prediction and label.
    """
    rows = aligned(labels, predictions, label, prediction)
    onset = P.onset_time("label")
    said = F.concat(F.lit("the label isn't an onset: stay "), F.col(ID).cast("string"))
    falls = (F.col(TIME) > onset) & (F.col("label") == 0)
    rows = rows.withColumn("label", F.when(falls, F.raise_error(said).cast("double")).otherwise(F.col("label")))
    if shift_left:
        rows = P.shift_label(rows, left=shift_left, right=shift_right, label="label").drop("label").withColumnRenamed("shifted", "label")
    return score(rows, prediction="prediction", label="label", **options)
