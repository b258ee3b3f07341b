"""Variables, column-name suffixes and the column sets built from them.

All functions work on lists of names and choose columns at plan time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The time-series variables by category, and the static and baseline columns.
VARIABLES = {
    "vitals": "hr o2sat temp sbp map dbp resp etco2 fio2".split(),
    "chemistry": "be bicar ph pco2 cl mg phos k cai na po2".split(),
    "organs": "ast bun alp ca crea bildir glu lact bili tri alb alt ck ckmb crp tnt urine".split(),
    "hemo": "hct hgb ptt wbc fgn plt basos bnd eos esr hbco inrpt lymph mch mchc mcv methb neut pt rbc rdw tco2".split(),
}
STATIC = ["age", "female", "weight", "height"]
BASELINE = ["sofa", "qsofa", "sirs", "news", "mews", "sresp", "scoag", "sliver", "scardio", "scns", "srenal"]
CHALLENGE = "hr o2sat temp sbp map dbp resp etco2 be bicar fio2 ph pco2 ast bun alp ca cl crea bildir glu lact mg phos k bili tri hct hgb ptt wbc fgn plt".split()

CHALLENGE_STATIC = ["age_static", "female_static"]

KEYS = ["stay_id", "stay_time"]
LABEL = "sep3"
LOOKBACK = re.compile(r"_(min|max|mean|median|var)_\d+_hours$")
SUFFIX_GROUPS = {
    "raw": "_raw", "locf": "_locf", "derived": "_derived", "indicator": "_indicator", "count": "_count",
    "wavelet": "_wavelet", "signature": "_signature", "static": "_static",
}
# The groups of each named feature set.
FEATURE_SETS = {
    "small": {"count", "derived", "id", "indicator", "raw", "time", "static"},
    "middle": {"count", "derived", "id", "indicator", "raw", "time", "static", "lookback", "locf", "label", "baseline", "other"},
    "raw": {"id", "raw", "time", "static"},
    "counts": {"id", "count", "time", "static"},
    "locf": {"id", "locf", "time", "static"},
}


def category(variable: str) -> str | None:
    return next((c for c, names in VARIABLES.items() if variable in names), None)


def in_category(name: str) -> list[str]:
    return VARIABLES[name]


def core_set(suffixes: tuple[str, ...] = ("raw", "locf")) -> list[str]:
    """Keys, label and all panel columns with the given suffixes; static and baseline columns have none."""
    series = [f"{v}_{s}" for s in suffixes for names in VARIABLES.values() for v in names]
    return [*KEYS, LABEL, *(f"{v}_static" for v in STATIC), *BASELINE, *series]


def base_name(column: str, suffixes: tuple[str, ...] = ("_raw", "_locf", "_derived", "_indicator", "_count", "_static")) -> str:
    """The column without its exact suffix."""
    return next((column[: -len(s)] for s in suffixes if column.endswith(s)), column)


def column_group(column: str) -> str:
    if column == "stay_id":
        return "id"
    if column == "stay_time":
        return "time"
    if column in (LABEL, "utility"):
        return "label"
    if column in BASELINE:
        return "baseline"
    if LOOKBACK.search(column):
        return "lookback"
    return next((g for g, s in SUFFIX_GROUPS.items() if s in column), "other")


def groups_of(columns: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(column_group(c), []).append(c)
    return out


def feature_set(columns: list[str], name: str = "small") -> list[str]:
    """Columns of a named set; `raw_vitals`, `counts_labs` and the like also cut by category."""
    base, _, cut = name.partition("_")
    chosen = [c for c in columns if column_group(c) in FEATURE_SETS[base]]
    if not cut:
        return chosen
    keep = set(VARIABLES["vitals"]) if cut == "vitals" else {v for k in ("chemistry", "organs", "hemo") for v in VARIABLES[k]}
    return [c for c in chosen if column_group(c) in ("id", "time", "static") or base_name(c) in keep]


def drop_categories(columns: list[str], categories: list[str], suffixes: tuple[str, ...] = ("_raw",)) -> list[str]:
    gone = {f"{v}{s}" for c in categories for v in VARIABLES[c] for s in suffixes}
    return [c for c in columns if c not in gone]


def challenge_set(columns: list[str]) -> list[str]:
    """Columns of the challenge's variables, with derived columns, keys and label."""
    heads = (*(f"{v}_" for v in CHALLENGE), *CHALLENGE_STATIC)
    return [c for c in columns if c in KEYS or c == LABEL or "_derived" in c or c.startswith(heads)]


def matching(columns: list[str], pattern: str, linear: bool = True) -> list[str]:
    """Columns that match, with statics; counts and indicators only for non-linear models."""
    find = re.compile(pattern)
    return [c for c in columns if c not in KEYS and (find.search(c) or c.endswith("_static") or (not linear and re.search("_(count|indicator)$", c)))]


def to_normalise(columns: list[str]) -> list[str]:
    """Columns that get a mean and a deviation: not keys, label, sex, baseline scores or indicators."""
    return [c for c in columns if column_group(c) not in ("id", "time", "label", "baseline", "indicator") and c not in ("female_static", "female")]


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def keep_first(df: DataFrame, k: int, always: tuple[str, ...] = ("stay_id", "stay_time", "sep3")) -> DataFrame:
    others = [c for c in df.columns if c not in always]
    return df.select(*[c for c in df.columns if c in always or c in others[:k]])


def strip_suffixes(df: DataFrame, suffixes: tuple[str, ...] = ("_raw",)) -> DataFrame:
    return df.withColumnsRenamed({c: base_name(c, suffixes) for c in df.columns})


def bool_to_float(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t == "boolean"})


def drop_all_missing(df: DataFrame, suffix: str = "_raw") -> DataFrame:
    """`df` without variables that have no value at all, and without what derives from them."""
    raw = [c for c in df.columns if c.endswith(suffix)]
    if not raw:
        return df
    counts = df.agg(*[F.count(c).alias(c) for c in raw]).first()
    empty = {base_name(c, (suffix,)) for c in raw if counts[c] == 0}
    return df.drop(*[c for c in df.columns if any(c.startswith(f"{v}_") for v in empty)])


def one_hot(df: DataFrame, column: str, levels: list[str], drop: tuple[str, ...] = ("Other", "Unknown")) -> DataFrame:
    """A 0/1 column for each level but the dropped ones; a null level is 0 everywhere."""
    made = {f"{column}_{lv}": F.coalesce((F.col(column) == lv).cast("int"), F.lit(0)) for lv in levels if lv not in drop}
    return df.withColumns(made).drop(column)


def where_equal(df: DataFrame, values: dict) -> DataFrame:
    for k, v in values.items():
        df = df.where(F.col(k) == v)
    return df
