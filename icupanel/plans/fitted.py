"""Pipelines of named steps that are fitted once, saved as tables, and applied to other sources.

A step's kind says how it is fitted and applied; its state is a small table, one
row a column or level, so a saved pipeline is a folder of Parquet and JSON that
any session can read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icupanel import schema
from icupanel.functions import windows
from icupanel.operators import stats
from icupanel.operators.evaluate import quantiles


class Kind(NamedTuple):
    fit: Callable[..., DataFrame] | None  #: (rows, **options) to the state; None where nothing is fitted
    apply: Callable[..., DataFrame]  #: (rows, state, **options) to the new rows


def _values(state: DataFrame) -> dict[str, tuple]:
    """The state on the driver: as many rows as columns."""
    return {r["column"]: tuple(r)[1:] for r in state.collect()}


def _of_columns(rows: DataFrame, columns: Sequence[str], shares: dict[str, float]) -> DataFrame:
    q = quantiles(rows.unpivot([], list(columns), "column", "v"), "v", list(shares.values()), ["column"])
    return q.select("column", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(shares)])


def _fit_means(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg(*[F.avg(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")


def _impute(rows: DataFrame, state: DataFrame, columns: Sequence[str], **_) -> DataFrame:
    known = _values(state)
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(known[c][0])) for c in columns if c in known and known[c][0] is not None})


def _clip(rows: DataFrame, state: DataFrame, **_) -> DataFrame:
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))) for c, (low, high) in _values(state).items()})


def _fit_levels(rows: DataFrame, column: str, least: float = 0.0) -> DataFrame:
    n = stats.level_percent(rows.where(F.col(column).isNotNull()), column)
    return n.where(F.col("percent") >= 100 * least).select(F.lit(column).alias("column"), F.col(column).cast("string").alias("level"))


def _one_hot(rows: DataFrame, state: DataFrame, column: str, **_) -> DataFrame:
    return schema.one_hot(rows, column, sorted(r.level for r in state.collect()))


def _fit_observed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], list(columns), "column", "n")


def _drop_unseen(rows: DataFrame, state: DataFrame, **_) -> DataFrame:
    return rows.drop(*[c for c, (n,) in _values(state).items() if n == 0])


KINDS: dict[str, Kind] = {
    "zscore": Kind(lambda rows, columns, eps=0.01: stats.normaliser(rows, columns, eps=eps), lambda rows, state, **_: stats.zscored(rows, state)),
    "impute_mean": Kind(_fit_means, _impute),
    "impute_median": Kind(lambda rows, columns: _of_columns(rows, columns, {"value": 0.5}), _impute),
    "clip": Kind(lambda rows, columns, low=0.01, high=0.99: _of_columns(rows, columns, {"low": low, "high": high}), _clip),
    "one_hot": Kind(_fit_levels, _one_hot),
    "drop_unseen": Kind(_fit_observed, _drop_unseen),
    "locf": Kind(None, lambda rows, _, columns, **options: windows.locf(rows, columns, **options)),
    "lookback": Kind(None, lambda rows, _, columns, sizes=(4, 8, 16): windows.lookback(rows, columns, sizes)),
    "select": Kind(None, lambda rows, _, columns: rows.select(*columns)),
}


@dataclass(frozen=True)
class Step:
    name: str
    kind: str
    options: dict


@dataclass(frozen=True)
class Fitted:
    steps: tuple[Step, ...]
    states: tuple[DataFrame | None, ...]

    def transform(self, rows: DataFrame) -> DataFrame:
        """All steps, one after the other; an error says which step it was in."""
        for step, state in zip(self.steps, self.states, strict=True):
            rows = _named(step, lambda: KINDS[step.kind].apply(rows, state, **step.options))
        return rows

    def save(self, path: str) -> None:
        """A folder with the steps as JSON and each state as Parquet."""
        spark = SparkSession.getActiveSession()
        rows = [(k, s.name, s.kind, json.dumps(s.options)) for k, s in enumerate(self.steps)]
        spark.createDataFrame(rows, "place int, name string, kind string, options string").coalesce(1).write.json(f"{path}/steps")
        for k, state in enumerate(self.states):
            if state is not None:
                state.write.parquet(f"{path}/state-{k}")


def _named(step: Step, run: Callable[[], DataFrame]) -> DataFrame:
    try:
        return run()
    except Exception as e:
        raise RuntimeError(f"in step {step.name}") from e


def fit(rows: DataFrame, steps: Sequence[tuple[str, str, dict]], kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> Fitted:
    """Steps given as (name, kind, options), each fitted on what the ones before make of `rows`.

    `kept` may store the rows that steps without a state have made before the
    next one is fitted; else every later fit goes through their windows again.
    """
    made, states, changed = [], [], False
    for name, kind, options in steps:
        if kind not in KINDS:
            raise ValueError(f"step {name}: no kind {kind}; there are {', '.join(sorted(KINDS))}")
        step = Step(name, kind, dict(options))
        if KINDS[kind].fit and changed:
            rows, changed = _named(step, lambda: kept(rows)), False
        state = _named(step, lambda: KINDS[kind].fit(rows, **options)) if KINDS[kind].fit else None
        rows = _named(step, lambda: KINDS[kind].apply(rows, state, **options))
        changed |= KINDS[kind].fit is None
        made.append(step)
        states.append(state)
    return Fitted(tuple(made), tuple(states))


def load(spark: SparkSession, path: str) -> Fitted:
    """A pipeline that `Fitted.save` wrote."""
    rows = sorted(spark.read.json(f"{path}/steps", schema="place int, name string, kind string, options string").collect())
    steps = tuple(Step(r.name, r.kind, json.loads(r.options)) for r in rows)
    return Fitted(steps, tuple(spark.read.parquet(f"{path}/state-{k}") if KINDS[s.kind].fit else None for k, s in enumerate(steps)))
