"""Near copies: SimHash links, verified by exact similarity, completed by a prefix filter, union-find.

Fingerprints within a small Hamming radius are linked by `simhash.link`, the
generalised pigeonhole search; each link stands if the texts' sets of word
shingles are as similar as asked.  Edited texts of that similarity may be further
apart than the radius, so what SimHash has not connected is met once more under
shingles, by a filter that misses no pair: two sets of which each shares at least a part `similarity` of itself with the
other have an element in common among the first n - ceil(similarity * n) + 1 of
each, whatever the order of elements, as long as it is the same for both.  So
every pair of similar texts meets in a bucket, at any size of the corpus; the
order, frequent shingles last, only keeps buckets small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icupanel.llm.common import beside, bucket_components, durable
from icupanel.llm.decontaminate import shingle_hashes
from icupanel.llm.simhash import fingerprint, link

SEED = 43


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words, words as in `simhash.fingerprint`.

    A text with fewer words is one run; without words it has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    return np.unique(shingle_hashes(hashes, max(1, min(words_per_shingle, len(words)))))


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def histogram(s: np.ndarray) -> bytes:
    """Counts of a set's hashes in about n / 4 ranges, a byte each; nothing where a count doesn't fit.

    What two sets share can't exceed the sum of the lesser counts of each range,
    which tells most unlike pairs apart at a small part of a text's size.
    """
    size = 1 << min(20, max(4, (len(s) // 4).bit_length()))
    counts = np.bincount((s >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_be_similar(a: bytes, b: bytes, similarity: float) -> bool:
    """False only for histograms of sets that can't have the similarity."""
    if not a or not b:
        return True
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    size = min(len(x), len(y))
    both = int(np.minimum(x.reshape(size, -1).sum(axis=1), y.reshape(size, -1).sum(axis=1)).sum())
    return both >= similarity * (int(x.sum()) + int(y.sum()) - both) - 1e-9


def common_shingles(rows: DataFrame, words_per_shingle: int, one_in: int = 32, least: int = 3, most: int = 200_000) -> np.ndarray:
    """Shingles that several of a sample of texts hold, from rare to common; an order only, no pair depends on it."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words_per_shingle).view(np.int64))], ["s"])

    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text")
    counts = sample.mapInArrow(spread, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "s").limit(most).collect()
    return np.array([r.s for r in reversed(top)], np.int64).view(np.uint64)


def signed(rows: DataFrame, common: np.ndarray, similarity: float, words_per_shingle: int) -> DataFrame:
    """(doc_id, hash, node, fp, n, counts, keys): hash tells texts apart, node sets of shingles; fp is the text's SimHash, n the set's size, counts its histogram, keys its prefix."""
    known = rows.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, places = known.value
        for batch in batches:
            nodes, fps, sizes, counts, keys = [], [], [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), words_per_shingle)
                n = len(s)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                fps.append(fingerprint(t.as_py()))
                sizes.append(n)
                counts.append(histogram(s))
                take = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    s = s[np.argsort(np.where(values[at] == s, places[at] + 1, 0), kind="stable")]
                keys.append(s[:take].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(np.array(v, np.uint64).view(np.int64)) for v in (nodes, fps)], pa.array(sizes, pa.int32()), pa.array(counts, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "hash", "node", "fp", "n", "counts", "keys"])

    return rows.select("doc_id", "hash", "text").mapInArrow(sign, f"doc_id {kind}, hash long, node long, fp long, n int, counts binary, keys array<long>")


def simhash_pairs(known: DataFrame, radius: int) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal or linked, one of each fingerprint standing for all of it."""
    own = durable(known.select("node", "fp").distinct())
    heads = durable(own.groupBy("fp").agg(F.min("node").alias("head")))
    equal = own.join(heads, "fp").select(F.col("node").alias("x"), F.col("head").alias("y"))
    side = lambda c, x: heads.select(F.col("fp").alias(c), F.col("head").alias(x))
    near = link(heads.select("fp"), radius).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    return equal.unionByName(near).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _small(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """`ids`, broadcast if there are at most `most`."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def _without(marked: DataFrame, gone: DataFrame) -> DataFrame:
    return marked.join(_small(gone), F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_hash")), "left_anti")


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, words_per_shingle: int = 5, radius: int = 2) -> DataFrame:
    """One row of each component of rows whose sets of word shingles have at least the given Jaccard similarity.

    Links within `radius` bits of SimHash come first, the others by the prefix
    filter; all are verified, so they are exact and complete, whatever the radius.  Sets are told apart by 64-bit hashes.  Of a
    component the row with the smallest doc_id stays, null ids last, then by the
    text's hash; of rows equal in both one stays.  Texts without words are copies
    of each other, null ones among them.  A text of any length is signed whole.
    An empty table stays empty; columns come out as they are, whatever their names.
    """
    mark = F.coalesce(F.xxhash64(F.col(text)), F.lit(0).cast("long"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), mark.alias("hash"), F.col(text).alias("text"))
    known = durable(signed(rows, common_shingles(rows, words_per_shingle), similarity, words_per_shingle))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    firsts = durable(known.groupBy("node").agg(F.min(place).alias("first")))
    met = known.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).select(F.col("node").alias("id"), "n", F.posexplode("keys").alias("at", "key"))
    counts = durable(known.groupBy("node").agg(F.first("counts").alias("counts")))

    def verify(pairs: DataFrame) -> DataFrame:
        @F.pandas_udf("boolean")
        def possible(a, b):
            import pandas as pd

            return pd.Series([may_be_similar(x, y, similarity) for x, y in zip(a, b)], dtype=bool)

        @F.pandas_udf("boolean")
        def similar(a, b):
            import pandas as pd

            return pd.Series([_similar(shingle_set(x, words_per_shingle), shingle_set(y, words_per_shingle), similarity) for x, y in zip(a, b)], dtype=bool)

        part = lambda c: counts.select(F.col("node").alias(c), F.col("counts").alias(f"counts_{c}"))
        pairs = durable(pairs.join(part("a"), "a").join(part("b"), "b").where(possible("counts_a", "counts_b")).select("a", "b"))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = durable(firsts.join(ends, "node", "left_semi").select("node", F.col("first.doc_id").alias("_id"), F.col("first.hash").alias("_hash")))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
        texts = durable(rows.join(_small(wanted), same).select("node", "text").dropDuplicates(["node"]))
        side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(similar("text_a", "text_b")).select("a", "b").distinct()

    labels = bucket_components(met, verify, similarity, rounds=1, most_rounds=1, first=simhash_pairs(known, radius))
    members = labels.join(firsts, "node").select("node", "component", "first")
    best = members.groupBy("component").agg(F.min("first").alias("best"))
    heads = firsts.join(members.join(best, "component").select(F.col("node").alias("_n"), "best"), F.col("node") == F.col("_n"), "left")
    heads = heads.select("node", F.coalesce("best", "first").alias("best"))
    gone = known.join(heads, "node").where(place != F.col("best")).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    kept = _without(beside(docs, id=F.col(doc_id), mark=mark), durable(gone))
    twice = durable(known.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).count().where("count > 1").select("_id", "_hash"))
    if not twice.isEmpty():
        again = kept.join(_small(twice), F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_hash")), "left_semi")
        kept = _without(kept, twice).unionByName(again.groupBy("id", "mark").agg(F.first("row").alias("row")).select("row", "id", "mark"))
    return kept.select("row.*")
