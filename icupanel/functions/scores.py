"""Rule-based severity scores and ratios as column expressions.

A missing input makes its criterion false, never the score null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def points(*terms: tuple[Column, float]) -> Column:
    """Sum of the points of all conditions that are true."""
    total = F.lit(0.0)
    for condition, n in terms:
        total = total + F.coalesce(condition, F.lit(False)).cast("double") * n
    return total


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def sirs_count(temp: Column, hr: Column, resp: Column, pco2: Column, wbc: Column) -> Column:
    either = lambda a, b: is_true(a) | is_true(b)
    return points((either(temp > 38, temp < 36), 1), (hr > 90, 1), (either(resp > 20, pco2 < 32), 1), (either(wbc < 4, wbc > 12), 1))


def sirs(temp: Column, hr: Column, resp: Column, pco2: Column, wbc: Column) -> Column:
    return (sirs_count(temp, hr, resp, pco2, wbc) >= 2).cast("double")


def mews(sbp: Column, hr: Column, resp: Column, temp: Column, low_rate: bool = False) -> Column:
    """`low_rate` adds the points for a heart rate below 40 that some versions leave out."""
    terms = [
        (sbp <= 70, 3), ((sbp > 70) & (sbp <= 80), 2), ((sbp > 80) & (sbp <= 100), 1), (sbp >= 200, 2),
        ((hr > 40) & (hr <= 50), 1), ((hr > 100) & (hr <= 110), 1), ((hr > 110) & (hr < 130), 2), (hr >= 130, 3),
        (resp < 9, 2), ((resp > 15) & (resp <= 20), 1), ((resp > 20) & (resp < 30), 2), (resp >= 30, 3),
        (temp < 35, 2), (temp >= 38.5, 2),
    ]
    return points(*terms, *([(hr < 40, 2)] if low_rate else []))


def qsofa(resp: Column, sbp: Column) -> Column:
    return points((resp >= 22, 1), (sbp <= 100, 1))


def sofa(plt: Column, bili: Column, map_: Column, crea: Column) -> Column:
    within = lambda c, a, b: (c > a) & (c <= b)
    return points(
        ((plt >= 100) & (plt < 150), 1), ((plt >= 50) & (plt < 100), 2), ((plt >= 20) & (plt < 50), 3), (plt < 20, 4),
        (bili.between(1.2, 1.9), 1), (within(bili, 1.9, 5.9), 2), (within(bili, 5.9, 11.9), 3), (bili > 11.9, 4),
        (map_ < 70, 1),
        (crea.between(1.2, 1.9), 1), (within(crea, 1.9, 3.4), 2), (within(crea, 3.4, 4.9), 3), (crea > 4.9, 4))


def septic_shock(map_: Column, lact: Column) -> Column:
    return points((map_ < 65, 1), (lact > 2, 1))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def add_scores(df: DataFrame, suffix: str = "_locf", names: dict[str, str] | None = None, low_rate: bool = False) -> DataFrame:
    """All scores and ratios as `*_derived`; a variable without a column counts as missing."""
    def v(name: str) -> Column:
        column = (names or {}).get(name, f"{name}{suffix}")
        return F.col(column) if column in df.columns else F.lit(None).cast("double")

    return df.withColumns({
        "ShockIndex_derived": ratio(v("hr"), v("sbp")), "bun_cr_derived": ratio(v("bun"), v("crea")), "po2_fio2_derived": ratio(v("po2"), v("fio2")),
        "SOFA_derived": sofa(v("plt"), v("bili"), v("map"), v("crea")), "qSOFA_derived": qsofa(v("resp"), v("sbp")),
        "SepticShock_derived": septic_shock(v("map"), v("lact")), "MEWS_derived": mews(v("sbp"), v("hr"), v("resp"), v("temp"), low_rate),
        "SIRS_derived": sirs(v("temp"), v("hr"), v("resp"), v("pco2"), v("wbc")),
    })


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the non-null values of a row; null without any."""
    total, n = F.lit(0.0), F.lit(0)
    for c in columns:
        total, n = total + F.coalesce(c.cast("double"), F.lit(0.0)), n + c.isNotNull().cast("int")
    return F.try_divide(total, n)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def baseline_probability(score: Column, low: float, most: float) -> Column:
    """A severity score as a probability: above its least value, over its range."""
    return (score - low) / most


def time_encoding(time: Column, channels: int, shortest: float = 1.0, longest: float = 168.0) -> list[Column]:
    """sin and cos of `time` at channels / 2 scales spread geometrically."""
    half = channels // 2
    step = (longest / shortest) ** (1 / max(1, half - 1))
    scales = [1 / (shortest * step**i) for i in range(half)]
    return [F.sin(time * s) for s in scales] + [F.cos(time * s) for s in scales]


def recode(column: Column, names: dict[str, str], other: str | None = None) -> Column:
    out = F.lit(other) if other is not None else column
    for k, v in names.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def parameter(key: Column, position: int) -> Column:
    """Part `position` (from 0) of a key like target_p1_p2; null beyond its parts."""
    return F.try_element_at(F.split(key, "_"), F.lit(position + 1))


def any_of(values: Column) -> Column:
    """Whether an array holds a value above 0, nulls aside; null if all are null."""
    known = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return F.when(F.size(known) > 0, F.exists(known, lambda x: x > 0))


def arg_max(values: Column) -> Column:
    """Position (from 0) of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1
