"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees, one feature after the other, learns a lookup
table of log-odds per feature; then pairs of features get two-dimensional tables
the same way.  A score is the sigmoid of the sum of one cell of every table, so
scoring is a handful of vectorised additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_bytes", "log_words", "word_length", "long_words", "upper", "digits", "spaces", "line_breaks", "non_ascii", "stops", "commas",
    "bangs", "bars", "symbols", "brackets", "other_punctuation", "control", "distinct_words", "top_word", "distinct_lines", "line_length",
    "capital_words", "alphabetic_words", "entropy", "repeated_pairs",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "spaces": b" ", "stops": b".", "commas": b",;:", "bangs": b"!?", "bars": b"|",
    "symbols": b"#$%&*@^~+=<>\\_", "brackets": b"()[]{}/", "other_punctuation": b"\"'-`",
}
_MEMBERS = np.zeros((len(_CLASSES), 256))
for _i, _bytes in enumerate(_CLASSES.values()):
    _MEMBERS[_i, list(_bytes)] = 1.0


def features(text: str | None) -> np.ndarray:
    """The whole text's features, all finite; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = dict(zip(_CLASSES, _MEMBERS @ hist / n))
    words = raw.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    share = hist[hist > 0] / n
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), lengths.sum() / m, (lengths > 15).sum() / m, classes["upper"], classes["digits"], classes["spaces"],
        hist[10] / n, hist[128:].sum() / n, classes["stops"], classes["commas"], classes["bangs"], classes["bars"], classes["symbols"], classes["brackets"],
        classes["other_punctuation"], (hist[:32].sum() - hist[9] - hist[10] - hist[13]) / n, len(counts) / m ** 0.75, max(counts.values(), default=0) / m,
        len(set(lines)) / max(1, len(lines)), np.log1p(len(raw) / max(1, len(lines))), sum(map(bytes.isupper, words)) / m, sum(map(bytes.isalpha, words)) / m,
        -(share * np.log2(share)).sum(), 1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ])


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        odds = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            odds += t[b[:, j]]
        for i, j, t in self.pairs:
            odds += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _stump_tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float, least: float) -> np.ndarray:
    """Leaf values over ordered bins: the best cut again and again, up to `leaves` leaves."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + smooth)
    while len(cuts) <= leaves:
        best = (1e-9, -1)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = np.where((ch[at] - ch[a] >= least) & (ch[b] - ch[at] >= least), gain_of(a, at) + gain_of(at, b) - gain_of(a, b), 0.0)
                k = int(gains.argmax())
                best = max(best, (float(gains[k]), int(at[k])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best four-leaf cross: one cut on either feature."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not i.size:
        return 0.0, np.zeros_like(g)
    corner = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    gains = sum(a**2 / (b + smooth) for a, b in zip(corner(cg), corner(ch)))
    a, b = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.empty_like(g)
    for rows in (slice(0, a + 1), slice(a + 1, None)):
        for cols in (slice(0, b + 1), slice(b + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + smooth)
    return float(gains[a, b]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, leaves: int = 3, smooth: float = 5.0) -> Model:
    """Fit on labelled rows; with none or one class only, the smoothed base rate."""
    base = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Model(float(np.log(base / (1 - base))))
    if len(y) < 2 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    odds = np.full(len(y), model.intercept)
    chance = lambda: 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    for _ in range(rounds):
        for j, size in enumerate(sizes):
            p = chance()
            tree = rate * _stump_tree(np.bincount(b[:, j], y - p, size), np.bincount(b[:, j], p * (1 - p), size), leaves, smooth, 1.0)
            model.tables[j] += tree
            odds += tree[b[:, j]]
    p = chance()

    def grid(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, shape = b[:, i] * sizes[j] + b[:, j], (sizes[i], sizes[j])
        return np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(len(sizes)), 2), key=lambda ij: -_pair_tree(*grid(*ij, p), smooth)[0])[:pairs]
    tables = {ij: np.zeros((sizes[ij[0]], sizes[ij[1]])) for ij in ranked}
    for _ in range(pair_rounds):
        for i, j in ranked:
            tree = rate * _pair_tree(*grid(i, j, chance()), smooth)[1]
            tables[i, j] += tree
            odds += tree[b[:, i], b[:, j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all documents that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", doc_id: str = "doc_id", text: str = "text", fit_rows: int = 20_000) -> Model:
    """Fit on about `fit_rows` labelled documents outside the held-out fifth, chosen by hash.

    This sample is the only one: it bounds what reaches the driver to fit_rows
    rows of some dozens of numbers, whatever the corpus.  Of several texts with
    one doc_id that with the smallest hash counts, of several labels the largest.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(target).cast("double").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y")))
    n = known.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = known.where(share < fit_rows / max(n, 1)).limit(2 * fit_rows)
    met = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    # one text an id, so that no more rows than ids reach the driver
    rows = met.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).tolist() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    got = rows.select("id", "y", "text").mapInArrow(extract, "id long, y double, x array<double>").toPandas().sort_values(["id", "y"])
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` with score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on).

    Null and empty texts are scored as empty texts.  Every row comes out once,
    in any order; columns named score or predicted are replaced.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = np.zeros((len(texts), len(FEATURES)))
        for i, t in enumerate(texts):
            rows[i] = features(t)
        return pd.Series(model.score(rows))

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
