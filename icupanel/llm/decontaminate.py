"""Benchmark decontamination: SimHash of item-sized windows and exact verification.

Documents are cut into windows of the benchmark items' lengths.  A window's
128-bit SimHash is compared with the items' by multi-index Hamming blocks: eight
blocks of 16 bits, of which one has to be within an eighth of the radius, so no
fingerprint within the radius is missed.  Candidates are then compared word
shingle by word shingle, weighted by rarity in the benchmark.

Windows without any shingle of the benchmark have similarity zero to every
item; they are left out before fingerprints are made, which loses nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icupanel.llm.common import beside, durable

BITS, BLOCKS, BLOCK_BITS = 128, 8, 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x5851F42D4C957F2D
#: Punctuation and spaces beyond ASCII, which part words like their ASCII kin.
_PARTING = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u3003\u3008-\u3011]")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_", *range(128, 256)]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        p[1:] = np.uint64(base)
        out.append(np.cumprod(p))
    return out[0], out[1]


def _piece_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and hash of each word: a polynomial in its bytes, by differences of running sums."""
    octets = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(octets) + 2, np.int8)
    word[1:-1] = _IN_WORD[octets]
    edge = np.diff(word)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(16, len(octets).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * up[: len(octets)], out=sums[1:])
    h = (sums[stop] - sums[start]) * down[start]
    h ^= h >> np.uint64(32)
    return start, h * _MIX


def word_hashes(texts: list[str | None], piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, one after the other, and each text's bounds in them.

    Words are runs of letters, digits, underscores and non-ASCII characters but
    punctuation, lower-cased.  Texts longer than `piece` bytes are cut at white space.
    """
    hashes, counts, held, ends = [], [], [], []

    def flush() -> None:
        if held:
            raw = b"\n".join(held)
            start, h = _piece_hashes(raw)
            hashes.append(h)
            counts.extend(np.diff(np.searchsorted(start, np.concatenate(([0], np.cumsum([len(x) + 1 for x in held]))))).tolist())
            held.clear()

    size = 0
    for text in texts:
        text = text or ""
        raw = (text if text.isascii() else _PARTING.sub(" ", text)).lower().encode("utf-8", "surrogatepass")
        parts = 1
        while len(raw) > piece:
            cut = max(raw.rfind(b" ", 0, piece), raw.rfind(b"\n", 0, piece))
            cut = cut if cut > 0 else piece
            held.append(raw[:cut])
            flush()
            raw, parts, size = raw[cut:], parts + 1, 0
        held.append(raw)
        size += len(raw)
        ends.append(parts)
        if size > piece // 2:
            flush()
            size = 0
    flush()
    marks = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), marks[np.concatenate(([0], np.cumsum(ends))).astype(np.int64)]


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit value for each run of k words."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _ODD[0] + hashes[j : j + n]
    out ^= out >> np.uint64(29)
    return out * _MIX


def _sums(shingles: np.ndarray) -> np.ndarray:
    """(n + 1, 128) running sums of +1 and -1; they wrap, but differences of up to 32767 rows are right."""
    two = np.stack([shingles * _ODD[1], shingles * _ODD[2]], axis=1)
    two ^= two >> np.uint64(31)
    bits = np.unpackbits(two.view(np.uint8), axis=1).view(np.int8)
    out = np.zeros((len(shingles) + 1, BITS), np.int16)
    np.cumsum(bits * np.int8(2) - np.int8(1), axis=0, dtype=np.int16, out=out[1:])
    return out


def _prints(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return np.packbits((sums[stop] - sums[start]) > 0, axis=1).view(np.uint64)


class _Class:
    """Items of near-equal length: one window size, and their blocks' index."""

    def __init__(self, window: int, k: int, items: list[int], prints: np.ndarray, block_radius: int):
        self.window, self.k, self.items, self.prints = window, k, np.array(items), prints
        flips = [sum(1 << b for b in c) for r in range(block_radius + 1) for c in combinations(range(BLOCK_BITS), r)]
        values = prints.view(np.uint16).reshape(-1, BLOCKS)
        self.heads, self.lists = [], []
        for b in range(BLOCKS):
            near = (values[:, b : b + 1] ^ np.array(flips, np.uint16)).ravel()
            owner = np.repeat(np.arange(len(items), dtype=np.int32), len(flips))
            order = np.argsort(near, kind="stable")
            self.heads.append(np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1)))
            self.lists.append(owner[order])

    def near(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        values = prints.view(np.uint16).reshape(-1, BLOCKS)
        found = []
        for b in range(BLOCKS):
            head = self.heads[b]
            v = values[:, b].astype(np.int64)
            low, many = head[v], head[v + 1] - head[v]
            hit = np.flatnonzero(many)
            if len(hit):
                many = many[hit]
                w = np.repeat(hit, many)
                i = self.lists[b][np.repeat(low[hit] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]
                gap = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1, dtype=np.int64)
                found.append(w[gap <= radius] * len(self.items) + i[gap <= radius])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // len(self.items), self.items[both % len(self.items)]


class Index:
    """The benchmark items of one pass, ready to meet documents."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = 5, radius: int = 31, similarity: float = 0.8, spread: float = 1.15, total: int | None = None, held_by: dict[int, int] | None = None):
        """`total` and `held_by` are the number of items and of those that hold a shingle, over all passes."""
        self.radius, self.similarity = radius, similarity
        self.ids = [i for i, _ in items]
        flat, bounds = word_hashes([t for _, t in items])
        hashes = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        self.lengths = [len(h) for h in hashes]
        self.k = [max(1, min(shingle, n)) for n in self.lengths]
        self.shingles = [Counter(shingle_hashes(h, k).tolist()) for h, k in zip(hashes, self.k)]
        df = Counter(s for c in self.shingles for s in c) if held_by is None else held_by
        total = len(items) if total is None else total
        self.weight = {s: math.log1p(total / n) for s, n in df.items()}
        self.other = math.log1p(total)
        self.classes: list[_Class] = []
        order = sorted((n, k, i) for i, (n, k) in enumerate(zip(self.lengths, self.k)) if n)
        while order:
            low, k, _ = order[0]
            group = [x for x in order if x[1] == k and (x[0] <= low * spread or x[0] == low)]
            order = [x for x in order if x not in group]
            members = [i for _, _, i in group]
            prints = np.concatenate([_prints(_sums(s := shingle_hashes(hashes[i], k)), np.array([0]), np.array([len(s)])) for i in members])
            self.classes.append(_Class(round((low + group[-1][0]) / 2), k, members, prints, radius // BLOCKS))
        self.longest = max(self.lengths, default=1)
        self.known = {k: np.array(sorted({s for c, kk in zip(self.shingles, self.k) if kk == k for s in c}), np.uint64) for k in set(self.k)}

    def spans(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, start, stop) of the stretches whose windows hold a benchmark shingle."""
        marked = []
        for k, known in self.known.items():
            s = shingle_hashes(hashes, k)
            low = np.zeros(1 << 16, bool)
            low[(known >> np.uint64(48)).astype(np.int64)] = True
            at = np.flatnonzero(low[(s >> np.uint64(48)).astype(np.int64)])
            marked.append(at[np.isin(s[at], known)])
        marks = np.unique(np.concatenate(marked)) if marked else np.zeros(0, np.int64)
        docs = np.searchsorted(bounds, marks, side="right") - 1
        out: list[tuple[int, int, int]] = []
        for d, at in zip(docs.tolist(), marks.tolist()):
            a, b = max(int(bounds[d]), at - 2 * self.longest), min(int(bounds[d + 1]), at + 2 * self.longest + 1)
            if out and out[-1][0] == d and a <= out[-1][2]:
                out[-1] = (d, out[-1][1], max(b, out[-1][2]))
            else:
                out.append((d, a, b))
        return out

    def likeness(self, item: int, window: Counter) -> float:
        mine, weight = self.shingles[item], lambda s: self.weight.get(s, self.other)
        both = sum(min(n, mine[s]) * weight(s) for s, n in window.items() if s in mine)
        all_mine = sum(n * weight(s) for s, n in mine.items())
        all_window = sum(n * weight(s) for s, n in window.items())
        return both / (all_mine + all_window - both) if both else 0.0

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """(document, item) -> (similarity, start) over documents lying in hashes[bounds[d]:bounds[d + 1]]."""
        out: dict[tuple[int, int], tuple[float, int]] = {}
        by_k: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.diff(bounds)
        doc_of = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(hashes)) - np.repeat(bounds[:-1], sizes)
        left = np.repeat(sizes, sizes) - inside
        for c in self.classes:
            if c.k not in by_k:
                s = shingle_hashes(hashes, c.k)
                by_k[c.k] = (s, _sums(s))
            shingles, sums = by_k[c.k]
            stride = max(1, c.window // 8)
            # whole windows at every stride, the last window, and the whole document where it is shorter
            start = np.flatnonzero(((left >= c.window) & (inside % stride == 0)) | (left == c.window) | ((inside == 0) & (left < c.window) & (left >= c.k)))
            for at in range(0, len(start), 1 << 16):
                a = start[at : at + (1 << 16)]
                b = a + np.minimum(c.window, left[a])
                w, items = c.near(_prints(sums, a, b - c.k + 1), self.radius)
                for x, i in zip(a[w].tolist(), items.tolist()):
                    d = int(doc_of[x])
                    n, lo, hi = self.lengths[i], int(bounds[d]), int(bounds[d + 1])
                    slack = stride + abs(n - c.window)
                    last = max(lo, hi - n)
                    for y in range(max(lo, x - slack), min(last, x + slack) + 1) if lo <= last else ():
                        near = self.likeness(i, Counter(shingles[y : min(y + n, hi) - c.k + 1].tolist()))
                        was = out.get((d, i))
                        if near >= self.similarity - 1e-12 and (was is None or (near, -(y - lo)) > (was[0], -was[1])):
                            out[d, i] = (near, y - lo)
        return out


def _held_by(items: DataFrame, shingle: int) -> DataFrame:
    """(s, n, passes): how many items hold each shingle, and the passes of those items."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, _ = word_hashes([t])
                s = np.unique(shingle_hashes(h, max(1, min(shingle, len(h)))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), p, np.int32)), pa.array(s.view(np.int64))], ["p", "s"])

    return durable(items.mapInArrow(spread, "p int, s long").groupBy("s").agg(F.count("*").alias("n"), F.collect_set("p").alias("passes")))


def find_passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, similarity: float = 0.8, items_a_pass: int = 1000, words_a_chunk: int = 100_000) -> DataFrame:
    """(key, item_id, similarity, start): documents that hold a benchmark item, and where best.

    Similarity is the weighted Jaccard of shingle multisets of the item and a
    window of its length; a shingle weighs ln(1 + items / items that hold it).
    `start` counts words.  Items without words match nothing; items shorter than
    a shingle are one shingle; items without a numeric id come out each under a
    null id; null and empty documents hold nothing; repeated documents come out
    each; a repeated item_id is several items, the best of which is reported.  Other columns are dropped.

    The benchmark goes through in passes of `items_a_pass` items, each with an
    index of bounded size; texts are cut into overlapping chunks, so memory
    does not grow with a text's length.  Documents are not shuffled.
    """
    spark = docs.sparkSession
    n = benchmark.count()
    passes = max(1, -(-n // items_a_pass))
    dealt = benchmark.select(F.col(item_id).try_cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    # rows of one id share a pass, so that the best of them is known there; those without an id are items of their own
    deal = F.pmod(F.when(F.col("i").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("i")), F.lit(passes))
    held_by = _held_by(dealt.select(deal.cast("int").alias("p"), "t"), shingle) if passes > 1 else None
    out = None
    for p in range(passes):
        items = sorted(((r.i, r.t) for r in dealt.where(deal == p).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        known = None if held_by is None else {r.s & (1 << 64) - 1: r.n for r in held_by.where(F.array_contains("passes", p)).select("s", "n").collect()}
        index = spark.sparkContext.broadcast(Index(items, shingle, similarity=similarity, total=n, held_by=known))

        def match(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):  # bounds the words held at once
                found = _match(index.value, batch.column(1).to_pylist(), words_a_chunk)
                keep = pa.array([d for d, *_ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(keep), *(pa.array(list(x), t) for x, t in zip(zip(*[f[1:] for f in found]) if found else ([], [], []), (pa.int64(), pa.float64(), pa.int64())))],
                    ["key", "item_id", "similarity", "start"])

        got = rows.mapInArrow(match, f"key {kind}, item_id long, similarity double, start long")
        out = got if out is None else out.unionByName(got)
    return out.withColumnRenamed("key", key)


def _match(index: Index, texts: list[str | None], words_a_chunk: int) -> list[tuple[int, int, float, int]]:
    """(document, item_id, similarity, start) over a batch of texts."""
    hashes, bounds = word_hashes(texts)
    best: dict[tuple[int, int | None, int], tuple[float, int]] = {}
    overlap = 2 * index.longest
    step = max(words_a_chunk, 2 * overlap)
    pieces = [(d, x, min(b, x + step + overlap)) for d, a, b in index.spans(hashes, bounds) for x in range(a, max(a + 1, b - overlap), step)]
    at = 0
    while at < len(pieces):
        chunk, size = [], 0
        while at < len(pieces) and (not chunk or size < words_a_chunk):
            chunk.append(pieces[at])
            size += pieces[at][2] - pieces[at][1]
            at += 1
        flat = np.concatenate([hashes[a:b] for _, a, b in chunk])
        ends = np.concatenate(([0], np.cumsum([b - a for _, a, b in chunk]))).astype(np.int64)
        for (h, i), (near, start) in index.hits(flat, ends).items():
            d, a, _ = chunk[h]
            k, new = (d, index.ids[i], i if index.ids[i] is None else -1), (near, start + a - int(bounds[d]))
            if k not in best or (new[0], -new[1]) > (best[k][0], -best[k][1]):
                best[k] = new
    return sorted(((d, i, round(near, 6), start) for (d, i, _), (near, start) in best.items()), key=lambda x: (x[0], x[1] is None, x[1] or 0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without those that hold a benchmark item, as `find_passages` has it; rows are told apart by doc_id and text.

    Null and empty texts stay; repeated rows stay or go together; a null doc_id
    is an id like any other.  An empty table of documents or of items changes
    nothing.  Columns of `docs` come out as they are, whatever their names.
    """
    marked = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash")).alias("key"), F.col(text).alias("text"))
    found = find_passages(marked, benchmark, "key", **options).select(F.col("key.id").alias("found_id"), F.col("key.hash").alias("found_hash")).distinct()
    whole = beside(docs, id=F.col(doc_id), hash=F.xxhash64(F.col(text)))
    return whole.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("hash") == F.col("found_hash")), "left_anti").select("row.*")
