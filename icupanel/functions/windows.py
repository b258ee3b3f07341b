"""Per-stay window features: all share one partitioning and order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS: dict[str, Callable[[str], Column]] = {
    "min": F.min, "max": F.max, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "var": F.var_samp,
}


def by_stay(id: str = "stay_id", time: str = "stay_time"):
    return Window.partitionBy(id).orderBy(time)


def last_rows(n: int, id: str = "stay_id", time: str = "stay_time"):
    return by_stay(id, time).rowsBetween(-(n - 1), 0)


def so_far(id: str = "stay_id", time: str = "stay_time"):
    return by_stay(id, time).rowsBetween(Window.unboundedPreceding, 0)


def lookback(df: DataFrame, columns: Sequence[str], windows: Sequence[int] = (4, 8, 16), stats: Sequence[str] = tuple(STATS), name: str = "{base}_{stat}_{w}_hours", suffixes: tuple[str, ...] = ("_raw",), **keys) -> DataFrame:
    """Statistics over the last w rows, the current one included, nulls left out."""
    strip = lambda c: next((c[: -len(s)] for s in suffixes if c.endswith(s)), c)
    return df.withColumns({
        name.format(base=strip(c), stat=s, w=w): STATS[s](c).over(last_rows(w, **keys)) for c in columns for w in windows for s in stats})


def lookback_lbk(df: DataFrame, columns: Sequence[str], windows: Sequence[int] = (4, 8, 16)) -> DataFrame:
    """The same without medians, under names like hr_mean4lbk."""
    return lookback(df, columns, windows, ("min", "max", "mean", "var"), "{base}_{stat}{w}lbk")


def missing_and_counts(df: DataFrame, columns: Sequence[str], suffix: str = "_raw") -> DataFrame:
    """`_indicator`: 1 where missing; `_count`: measurements so far."""
    base = {c: c.removesuffix(suffix) for c in columns}
    return df.withColumns({f"{b}_indicator": F.col(c).isNull().cast("int") for c, b in base.items()} | {f"{b}_count": F.count(c).over(so_far()) for c, b in base.items()})


def observed_and_counts(df: DataFrame, columns: Sequence[str], suffix: str = "_raw") -> DataFrame:
    """`_ind`: 1 where observed; `_cnt`: its running sum."""
    base = {c: c.removesuffix(suffix) for c in columns}
    return df.withColumns({f"{b}_ind": F.col(c).isNotNull().cast("int") for c, b in base.items()} | {f"{b}_cnt": F.sum(F.col(c).isNotNull().cast("int")).over(so_far()) for c, b in base.items()})


def locf(df: DataFrame, columns: Sequence[str], suffix: str = "_raw", to: str = "_locf", fill: float | None = None) -> DataFrame:
    """Last observation carried forward within a stay; `fill` before the first."""
    held = lambda c: F.last(c, ignorenulls=True).over(so_far())
    return df.withColumns({c.removesuffix(suffix) + to: F.coalesce(held(c), F.lit(fill)) if fill is not None else held(c) for c in columns})


def deterioration(score: Column, rows: int = 24) -> Column:
    """Rise above the least value of the last `rows` rows, at least 0."""
    return F.greatest(score - F.min(score).over(last_rows(rows)), F.lit(0.0))


def deterioration_before(score: Column, rows: int = 24) -> Column:
    """Rise above the least of the rows before; null in the first row, may be negative."""
    return score - F.min(score).over(by_stay().rowsBetween(-(rows - 1), -1))


def deteriorated(score: Column, rows: int = 24, by: float = 2) -> Column:
    return F.coalesce(score - F.min(score).over(last_rows(rows)) >= by, F.lit(False)).cast("int")


def delta_cummin(score: Column) -> Column:
    """Rise above the least value so far."""
    return score - F.min(score).over(so_far())


def position() -> Column:
    return F.row_number().over(by_stay()).cast("long") - 1


def sticky(flag: Column) -> Column:
    """1 from the first true flag of a stay on."""
    return F.max(F.coalesce(flag, F.lit(False)).cast("int")).over(so_far())


def augment(df: DataFrame, fun: Callable[[str], Column], suffix: str, columns: Sequence[str], by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """One function over many columns: per row, per group (`by`) or over the last `rows` rows of a stay."""
    def made(c: str) -> Column:
        if rows is not None:
            return fun(c).over(last_rows(rows))
        return fun(c).over(Window.partitionBy(*by)) if by else fun(c)

    return df.withColumns({f"{c.removesuffix('_raw')}_{suffix}": made(c) for c in columns})


def haar(df: DataFrame, column: str, name: str, rows: int = 32, levels: int = 5) -> DataFrame:
    """Multi-scale differences: mean of the newer half less mean of the older half of the last `rows`, halved again and again; null where either half has no value."""
    made = {}
    for level in range(levels):
        half = rows >> (level + 1)
        newer = F.avg(column).over(by_stay().rowsBetween(-(half - 1), 0))
        older = F.avg(column).over(by_stay().rowsBetween(-(2 * half - 1), -half))
        made[f"{name}_wavelet_{level}"] = newer - older
    return df.withColumns(made)
