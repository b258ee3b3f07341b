"""Exact top-k by inner product over an impact-ordered index, score at a time.

The index is cut into blocks of vectors.  In a block, each dimension has one
posting segment per quantised level of its components: the vectors that lie in
that level.  A query takes the segments of all dimensions in order of falling
impact, |query component| times level, and adds each impact to the accumulators
of the segment's vectors.  It stops only when the bounds prove all but a few
vectors out of the k best, and rescores the possible members exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icupanel.llm.common import durable


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(fit, F.lit(False)), whole)


class Postings(NamedTuple):
    """Segments of one block: those of a dimension side by side, by rising level."""

    shift: np.ndarray  #: (dims,) components of one level differ in this many low bits
    last: np.ndarray  #: (dims,) the highest level
    counts: np.ndarray  #: (dims, levels) vectors of a segment
    vectors: np.ndarray  #: (dims * vectors,) the segments' vectors, as places in the block


def invert(block: np.ndarray, bits: int) -> Postings:
    """Postings of a block of integer vectors, with at most 2**bits levels a dimension (8 bits at most)."""
    low = block.min(axis=0)
    reach = block.max(axis=0) - low
    shift = np.array([max(0, int(r).bit_length() - bits) for r in reach], np.int64)
    level = ((block - low) >> shift).astype(np.uint8)
    dims, levels = block.shape[1], 1 << bits
    counts = np.bincount((level + np.arange(dims) * levels).ravel(), minlength=dims * levels).reshape(dims, levels)
    return Postings(shift, reach >> shift, counts, np.argsort(level, axis=0, kind="stable").T.ravel())


class Found(NamedTuple):
    ids: np.ndarray
    scores: np.ndarray
    read: int  #: postings read until the stop
    rescored: int


def search(block: np.ndarray, ids: np.ndarray, postings: Postings, query: np.ndarray, query_id: int, k: int, few: int = 64, turn: int = 4) -> Found:
    """The k best vectors of a block for one query, ties to the smaller id; rows of the query's own id take no part.

    A component is at least the low edge of its level, so an accumulator is a
    lower bound of a score (less a sum that all vectors have in common).  All
    segments with an impact above c have been read, so a dimension that a vector
    wasn't met in adds at most c, nor more than the dimension's greatest impact;
    in the others only the rest inside a level is unknown.  A negative query
    component takes its levels from the top.  The bounds are looked at whenever
    `turn` postings a vector have been read; the search stops once at most
    few * k vectors can reach the k-th greatest lower bound, or at the end.
    """
    n = len(ids)
    weight = np.abs(query).astype(np.float64)
    unit = weight * np.exp2(postings.shift)
    rise = np.arange(postings.counts.shape[1])
    impact = (unit[:, None] * np.where(query[:, None] > 0, rise, postings.last[:, None] - rise)).ravel()
    counts = postings.counts.ravel()
    starts = np.cumsum(counts) - counts
    segments = np.flatnonzero((impact > 0) & (counts > 0))
    segments = segments[np.argsort(-impact[segments], kind="stable")]
    ends = np.cumsum(counts[segments])
    read = int(ends[-1]) if len(ends) else 0
    stops = np.unique(np.append(np.searchsorted(ends, np.arange(turn * n, read, turn * n)) + 1, len(segments))) if read else ()
    top = unit * postings.last
    inside = (weight * (np.exp2(postings.shift) - 1)).sum()
    slack = 4e-16 * (len(query) + 1) * (top.sum() + inside)  # of sums in floating point
    own = ids == query_id
    sums, met, alive, begin = np.zeros(n), np.zeros(n), ~own, 0
    for stop in stops:
        now = segments[begin:stop]
        size = counts[now]
        hit = postings.vectors[np.repeat(starts[now] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        sums += np.bincount(hit, np.repeat(impact[now], size), n)
        met += np.bincount(hit, minlength=n)
        c = impact[segments[stop]] if stop < len(segments) else 0.0
        most = sums + (np.minimum(c, top).sum() + inside) - c * met
        least = np.where(own, -1.0, sums)
        kth = np.partition(least, n - min(k, n))[n - min(k, n)]
        alive = (most >= kth - slack) & ~own
        begin = stop
        if alive.sum() <= few * k:
            read = int(ends[stop - 1])
            break
    possible = np.flatnonzero(alive)
    scores = block[possible].astype(np.int64) @ query
    best = np.lexsort((ids[possible], -scores))[:k]
    return Found(ids[possible[best]], scores[best], read, len(possible))


def _smallest(m: np.ndarray) -> np.ndarray:
    """`m` in the narrowest integers that hold it."""
    return m.astype(np.result_type(np.int16, np.min_scalar_type(m.min(initial=0)), np.min_scalar_type(-1 - m.max(initial=0))))


def _stacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of rows; missing components are zero, and there is one dimension at least."""
    m = np.zeros((len(pdf), max(1, max(map(len, pdf["vector"]), default=1))), np.int64)
    for i, v in enumerate(pdf["vector"]):
        m[i, : len(v)] = v
    return pdf["vec_id"].to_numpy(np.int64), m


def _packed(rows: DataFrame) -> DataFrame:
    """Stacks of rows as (deal, width, kind, ids, vectors): one row a stack."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = _stacked(pdf)
        m = _smallest(m)
        return pd.DataFrame({"deal": [key[0]], "width": [m.shape[1]], "kind": [m.dtype.str], "ids": [ids.tobytes()], "vectors": [m.tobytes()]})

    return rows.groupBy("deal").applyInPandas(pack, "deal long, width int, kind string, ids binary, vectors binary")


def _indexed(rows: DataFrame, bits: int) -> DataFrame:
    """Blocks of the index: like `_packed`, with the block's postings."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = _stacked(pdf)
        p = invert(m, bits)
        m = _smallest(m)
        return pd.DataFrame({
            "deal": [key[0]], "width": [m.shape[1]], "kind": [m.dtype.str], "ids": [ids.tobytes()], "vectors": [m.tobytes()], "shift": [p.shift.tobytes()], "last": [p.last.tobytes()],
            "counts": [p.counts.astype(np.int32).tobytes()], "post_kind": ["<u2" if len(ids) <= 1 << 16 else "<u4"],
            "posts": [p.vectors.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32).tobytes()]})

    return rows.groupBy("deal").applyInPandas(
        pack, "deal long, width int, kind string, ids binary, vectors binary, shift binary, last binary, counts binary, post_kind string, posts binary")


def _search_units(batches: Iterator[pd.DataFrame], k: int, few: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            ids, query_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
            block = np.frombuffer(r.vectors, r.kind).reshape(len(ids), r.width)
            postings = Postings(
                np.frombuffer(r.shift, np.int64), np.frombuffer(r.last, np.int64), np.frombuffer(r.counts, np.int32).astype(np.int64).reshape(r.width, -1),
                np.frombuffer(r.posts, r.post_kind).astype(np.int32))
            # components beyond a block's dimensions meet zeros
            queries = np.zeros((len(query_ids), max(r.width, r.q_width)), np.int64)
            queries[:, : r.q_width] = np.frombuffer(r.q_vectors, r.q_kind).reshape(len(query_ids), r.q_width)
            found = [search(block, ids, postings, query, query_id, k, few) for query_id, query in zip(query_ids, queries[:, : r.width])]
            yield pd.DataFrame({
                "query_id": np.repeat(query_ids, [len(f.ids) for f in found]), "vec_id": np.concatenate([f.ids for f in found]), "score": np.concatenate([f.scores for f in found])})


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256,
    index_block: int = 8192, query_block: int = 1024, bits: int = 6, few: int = 64, units: int = 32,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Components are floor(scale * x); scores have to fit 64 bits.  Every row but
    the query's own is a candidate; ties go to the smaller vec_id; with fewer
    candidates all come out.  Vectors that are null or hold null or non-finite
    components, and rows without a vec_id, take no part; of vectors of different
    lengths the missing components count as zero; empty vectors score zero.
    Rows of one vec_id are candidates each for themselves, but not for queries
    of that id; a repeated query row is searched once, with the largest of its
    vectors.  Other columns are dropped.  An empty table gives no rows.

    The rows are dealt by hash into index blocks of about `index_block` rows,
    the queries into stacks of at most about `query_block`, smaller ones if there
    would be fewer than `units` pairs of block and stack; each pair is one unit
    of work that sends on k rows a query.  `bits`: 2**bits levels a dimension.
    """
    rows = durable(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("vector"), is_query.alias("is_query"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()))
    asked = rows.where("is_query").groupBy("vec_id").agg(F.max("vector").alias("vector"))
    n, m = rows.count(), rows.where("is_query").count()
    blocks = max(1, -(-n // index_block))
    stacks = max(1, -(-m // query_block), min(-(-m // 32), -(-units // blocks)))
    # the vector in the hash keeps many rows of one vec_id apart, the number copies of one row
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    index = durable(_indexed(rows.withColumn("deal", F.pmod(F.xxhash64("vec_id", "vector", salt), F.lit(blocks))), bits))
    stack = durable(_packed(asked.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(stacks))))).select(
        F.col("width").alias("q_width"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("deal"))
    met = index.join(stack, "deal").repartition(min(blocks * stacks, 10_000))
    found = met.mapInPandas(lambda batches: _search_units(batches, k, few), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
