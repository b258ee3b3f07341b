"""SimHash near-duplicate detection with a generalised pigeonhole search.

Fingerprints within a small Hamming radius are found exactly: the 64 bits are
cut into partitions of correlated bits, each partition gets its own threshold
(possibly -1: not probed) from a dynamic programme over estimated costs, and by
the general pigeonhole principle every pair within the radius agrees with at
least one partition's threshold.  Candidates are verified by exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icupanel.llm.common import beside, connected_components, durable

BITS = 64
SEED = 42


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of a text, as an unsigned integer.

    Words are runs without ASCII white space after lower-casing A-Z; shingles
    are space-joined and repeats count; with fewer words the whole sequence is
    the one shingle; without words the fingerprint is zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words_per_shingle, len(words)) - 1 :][:n] - 1).tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the memory of one very long text
        part = [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])]
        part.append(bytes(8 * (-len(part) % 128)))  # whole groups of 128, whose sums fit in a byte
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8)).reshape(-1, 128, BITS)
        ones += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """`docs` with a long column `fp`, the text's SimHash as a signed integer."""

    @F.pandas_udf("long")
    def sign(texts: pd.Series) -> pd.Series:
        got = np.fromiter((fingerprint(t, words_per_shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(got.view(np.int64))

    return docs.withColumn("fp", sign(F.col(text)))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all rows.

    Every task sends one partial matrix (2080 sums), whatever its rows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                total += np.rint(bits[at : at + (1 << 16)].T @ bits[at : at + (1 << 16)]).astype(np.int64)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(partial, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together = np.zeros((BITS, BITS), np.int64)
    for r in rows:
        together[r.i, r.j] = together[r.j, r.i] = r.n
    return fps.count(), together


def _bits(values: np.ndarray) -> np.ndarray:
    """(n, 64) zeros and ones; column j is the bit of weight 2**j."""
    octets = np.ascontiguousarray(values.astype(np.int64)).view(np.uint64).astype("<u8").view(np.uint8)
    return np.unpackbits(octets.reshape(-1, 8), axis=1, bitorder="little")


def _agreement(n: int, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that two rows agree in a bit, and in two bits at once."""
    n = max(n, 1)
    p11 = together / n
    p = np.diag(p11)
    p10 = p[:, None] - p11
    p01 = p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    return p**2 + (1 - p) ** 2, p11**2 + p10**2 + p01**2 + p00**2


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near-equal size, correlated bits side by side."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        pool = sorted(left)
        first = max(pool, key=lambda i: (sum(corr[i, j] for j in pool if j != i), -i))
        group = [first]
        left.remove(first)
        while len(group) < width:
            best = max(sorted(left), key=lambda i: (max(corr[i, j] for j in group), -i))
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def _closeness(group: list[int], one: np.ndarray, two: np.ndarray, radius: int) -> list[float]:
    """Estimated chance that two rows differ in at most 0, 1, ... `radius` bits of a group.

    Each bit's disagreement is taken given agreement in the earlier bit of the
    group that tells most about it.
    """
    chances = np.zeros(radius + 1)
    chances[0] = 1.0
    for k, i in enumerate(group):
        agree = max([one[i], *(two[i, j] / max(one[j], 1e-12) for j in group[:k])])
        agree = min(1.0, agree)
        chances = chances * agree + np.concatenate(([0.0], chances[:-1])) * (1 - agree)
    return list(np.cumsum(chances))


def plan(n: int, together: np.ndarray, radius: int, most_parts: int = 6, verify_cost: float = 1.0, probe_cost: float = 4.0) -> list[tuple[list[int], int]]:
    """The cheapest (bits, threshold) list whose thresholds add up to radius - parts + 1.

    Costs are estimated numbers of candidate pairs plus probes.  A threshold of
    -1 leaves a partition out.
    """
    one, two = _agreement(n, together)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, most_parts + 1):
        groups = group_bits(n, together, parts)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of (threshold + 1) so far
        for group in groups:
            near = _closeness(group, one, two, radius)
            costs = [0.0]
            for e in range(radius + 1):
                probes = sum(math.comb(len(group), x) for x in range(e + 1))
                costs.append(verify_cost * n * n / 2 * near[e] + probe_cost * n * probes)
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for e, more in enumerate(costs):
                    if used + e <= radius + 1 and (used + e not in step or step[used + e][0] > cost + more):
                        step[used + e] = (cost + more, [*chosen, e - 1])
            table = step
        cost, thresholds = table[radius + 1]
        if best is None or cost < best[0]:
            best = (cost, list(zip(groups, thresholds)))
    return [(g, t) for g, t in best[1] if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(bits: list[int], flips: int) -> list[int]:
    """Masks with at most `flips` of `bits` set, as signed integers."""
    return [_signed(sum(1 << b for b in c)) for k in range(flips + 1) for c in combinations(bits, k)]


def link(fps: DataFrame, radius: int = 2, bucket_limit: int = 4096, scale: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within `radius`.

    `fps` has distinct non-null values in `fp`.  Buckets of up to `bucket_limit`
    fingerprints are joined pairwise, distance test inside the join.  Members of
    larger buckets are linked without pairs: two of them are within the radius
    exactly if they are equal once some `radius` bits are cleared, so each
    cleared form links its members to the smallest.  `scale` plans for another
    number of rows than there are (tests).
    """
    n, together = bit_statistics(fps)
    factor = (scale or n) / max(n, 1)
    chosen = plan(scale or n, np.rint(together * factor).astype(np.int64), radius)
    key = lambda bits: F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
    index = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), key(bits).alias("key")) for i, (bits, _) in enumerate(chosen)])).alias("at")
    ).select("fp", "at.part", "at.key")
    tries = [
        F.struct(F.lit(i).alias("part"), key(bits).bitwiseXOR(F.lit(m)).alias("key"))
        for i, (bits, t) in enumerate(chosen) for m in _masks(bits, t)
    ]
    probe = index if all(t == 0 for _, t in chosen) else fps.select("fp", F.explode(F.array(*tries)).alias("at")).select("fp", "at.part", "at.key")
    hot = durable(index.groupBy("part", "key").count().where(F.col("count") > bucket_limit).select("part", "key"))
    any_hot = hot.limit(1).count() > 0
    if any_hot:
        crowd = index.join(hot, ["part", "key"], "left_semi").select("fp").unionByName(probe.join(hot, ["part", "key"], "left_semi").select("fp")).distinct()
        index, probe = (x.join(hot, ["part", "key"], "left_anti") for x in (index, probe))
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius
    pairs = probe.alias("l").join(
        index.alias("r"),
        (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & near,
    ).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    if any_hot:
        masks = [_signed(((1 << BITS) - 1) ^ sum(1 << b for b in c)) for c in combinations(range(BITS), radius)]
        cleared = crowd.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("mask", "keep")).select(
            "fp", "mask", F.col("fp").bitwiseAND(F.col("keep")).alias("form"))
        lowest = cleared.groupBy("mask", "form").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
        pairs = pairs.unionByName(cleared.join(lowest, ["mask", "form"]).where("fp != a").select("a", F.col("fp").alias("b")))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, words_per_shingle: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest doc_id whose fingerprint can be reached over
    links of at most `radius` differing bits.  Null and empty texts share the
    zero fingerprint, which links like any other.  Repeated rows come out as
    often as they went in; a null doc_id stays null and gives no component its
    name, so a component of null ids only is null.  Other columns are dropped.
    """
    signed = durable(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words_per_shingle).select("doc_id", "fp"))
    firsts = durable(signed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    labels = connected_components(link(firsts.select("fp"), radius, bucket_limit))
    members = labels.join(firsts, F.col("node") == F.col("fp")).select("node", "component", "first")
    smallest = members.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = members.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    named = firsts.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # at most a thousand fingerprints are held by more than a thousandth of the rows: those meet their names by broadcast
    most = max(8, signed.count() // 1000)
    hot = F.broadcast(firsts.where(F.col("rows") > most).select(F.col("fp").alias("_hot")))
    few = signed.join(hot, F.col("fp") == F.col("_hot"), "left_anti").join(named, "fp")
    many = signed.join(F.broadcast(named.join(hot, F.col("fp") == F.col("_hot"), "left_semi")), "fp")
    return few.unionByName(many).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """`docs` without those whose component is named by another document.

    Rows without a doc_id stay: they can't be told apart by id.  An empty table
    stays empty; columns come out as they are, whatever their names.
    """
    marks = near_duplicates(docs, doc_id, **options)
    others = marks.where("component_id != doc_id").select(F.col("doc_id").alias("other")).distinct()
    return beside(docs, id=F.col(doc_id)).join(others, F.col("id") == F.col("other"), "left_anti").select("row.*")
