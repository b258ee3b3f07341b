"""Token alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cut a text into pieces of bytes; a byte offset where both end a
token is a shared cut.  In a stretch of text a cut near the middle is found by
bisecting each tokenizer's ends for the other's, and both halves are treated
likewise; a stretch without a cut inside is a group.  Where a space follows a
non-space both tokenizers always cut, so texts are first parted there, and
equal parts of a task's documents are encoded and aligned once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icupanel.llm.common import durable
from icupanel.llm.tokens import added_tokens, frequent

#: A part begins with a space after a non-space (or at the start) and goes up to the next such space.
PART = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")


class Vocabularies(NamedTuple):
    a: object
    b: object
    a_bytes: list[bytes]  #: the bytes of each id
    b_bytes: list[bytes]
    space: int  #: B's id of a space alone


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """Both tokenizers and their ids' bytes; raises where the texts' parts couldn't be encoded apart."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core only
    added_tokens(a_path)  # raises for other kinds than byte-level BPE
    a, b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    byte_of = byte_alphabet()
    a_bytes = [bytes(byte_of.get(c, 63) for c in a.id_to_token(i) or "") for i in range(a.get_vocab_size())]
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces) or b.encode("x  y", out_type=str) != b.encode("x", out_type=str) + b.encode(" y", out_type=str):
        raise ValueError(f"{b_path}: its pieces reach over spaces between words")
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    if len(a_bytes) * len(b_bytes) >= 1 << 31:
        raise ValueError("pairs of ids have to fit 31 bits")
    return Vocabularies(a, b, a_bytes, b_bytes, b.piece_to_id("▁"))


def shared_cuts(a: np.ndarray, b: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups begin in `a` and in `b`, rising.

    a and b are the rising ends of tokens, a_lo to b_hi the stretches: tokens
    a_lo up to a_hi and b_lo up to b_hi, whose last ends are equal.  All
    stretches are halved side by side.  From the middle of a stretch the search
    goes up, each array bisected for the other's next end, until both agree; if
    nothing is found up to the stretch's end it goes down from the middle.
    """
    done_a, done_b = [], []
    while len(a_lo):
        whole = (a_hi - a_lo < 2) | (b_hi - b_lo < 2)  # one token on a side has no end inside
        middle = (a_lo + a_hi - 2) // 2
        cut_a = np.full(len(a_lo), -1)
        cut_b = np.full(len(a_lo), -1)
        for up in (True, False):
            k = np.flatnonzero(~whole & (cut_a < 0))
            i = middle[k]
            while len(k):
                if up:
                    j = np.searchsorted(b, a[i])  # b's first end that isn't before a's
                    k, i, j = (x[j < b_hi[k] - 1] for x in (k, i, j))
                else:
                    j = np.searchsorted(b, a[i], "right") - 1  # b's last end that isn't after a's
                    k, i, j = (x[j >= b_lo[k]] for x in (k, i, j))
                same = a[i] == b[j]
                cut_a[k[same]], cut_b[k[same]] = i[same], j[same]
                k, j = k[~same], j[~same]
                if up:
                    i = np.searchsorted(a, b[j])
                    k, i, j = (x[i < a_hi[k] - 1] for x in (k, i, j))
                else:
                    i = np.searchsorted(a, b[j], "right") - 1
                    k, i, j = (x[i >= a_lo[k]] for x in (k, i, j))
        leaf = cut_a < 0
        done_a.append(a_lo[leaf])
        done_b.append(b_lo[leaf])
        x, y, cut = cut_a[~leaf] + 1, cut_b[~leaf] + 1, ~leaf
        a_lo, a_hi = np.concatenate([a_lo[cut], x]), np.concatenate([x, a_hi[cut]])
        b_lo, b_hi = np.concatenate([b_lo[cut], y]), np.concatenate([y, b_hi[cut]])
    none = np.zeros(0, np.int64)
    return np.sort(np.concatenate([none, *done_a])), np.sort(np.concatenate([none, *done_b]))


#: Of a part: tokens of A (negative where a tokenizer doesn't give back the part), groups as in a1,a2|b1;a3|b2; and the links' int32 codes, A's id * size of B + B's id.
Part = tuple[int, str, bytes]
LOST: Part = (-1 << 40, "", b"")


def _encoded(texts: list[str], v: Vocabularies) -> tuple[list[list[int]], list[list[int]], list[bool]]:
    """Ids of A and B for texts that begin with a space, and whether both give the text back."""
    a_ids = [e.ids for e in v.a.encode_batch_fast(texts, add_special_tokens=False)]
    b_ids = [x if t != " " else [v.space] for t, x in zip(texts, v.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]  # B adds the space itself
    joined = lambda ids, known: b"".join(map(known.__getitem__, ids))
    return a_ids, b_ids, [joined(a, v.a_bytes) == joined(b, v.b_bytes) == t.encode() for t, a, b in zip(texts, a_ids, b_ids, strict=True)]


def _ends(ids: list[list[int]], known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.fromiter(chain.from_iterable(ids), np.int64)
    return flat, np.cumsum(np.fromiter(map(len, known), np.int64, len(known))[flat])


@lru_cache(maxsize=4)
def _shown(n: int, last: str) -> np.ndarray:
    """Each id with a comma, then each with `last`."""
    return np.array([f"{i}," for i in range(n)] + [f"{i}{last}" for i in range(n)], object)


def align_parts(parts: Sequence[str], v: Vocabularies, run: int = 64, at_once: int = 64) -> dict[str, Part]:
    """The alignment of distinct parts, each beginning with a space.

    Parts are encoded in runs of `run`, `at_once` runs at a time; those that end with white space, which
    only a text's last part does, are encoded alone, as are those of runs that a
    tokenizer doesn't give back.
    """
    plain = [p for p in parts if not p[-1].isspace()]
    waiting = [plain[k : k + run] for k in range(0, len(plain), run)] + [[p] for p in parts if p[-1].isspace()]
    out: dict[str, Part] = {}
    while waiting:
        runs, waiting = waiting[-at_once:], waiting[:-at_once]
        a_ids, b_ids, good = _encoded(["".join(r) for r in runs], v)
        kept = [k for k, ok in enumerate(good) if ok]
        own = [p for k in kept for p in runs[k]]
        if own:
            out |= zip(own, _aligned([a_ids[k] for k in kept], [b_ids[k] for k in kept], np.cumsum([len(p.encode()) for p in own]), v), strict=True)
        for r, ok in zip(runs, good, strict=True):
            if not ok and len(r) == 1:
                out[r[0]] = LOST
            elif not ok:
                waiting += [[p] for p in r]
    return out


def _aligned(a_ids: list[list[int]], b_ids: list[list[int]], stops: np.ndarray, v: Vocabularies) -> Iterator[Part]:
    """The parts that end at the byte offsets `stops` of all tokens together."""
    (a, a_ends), (b, b_ends) = _ends(a_ids, v.a_bytes), _ends(b_ids, v.b_bytes)
    a_at, b_at = (np.concatenate([[0], np.searchsorted(e, stops) + 1]) for e in (a_ends, b_ends))
    a_cut, b_cut = shared_cuts(a_ends, b_ends, a_at[:-1], a_at[1:], b_at[:-1], b_at[1:])
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)]  # between two ends in a row lies one token of each
    links = (a[np.searchsorted(a_ends, ends)] * len(v.b_bytes) + b[np.searchsorted(b_ends, ends)]).astype("<i4").tobytes()
    # tokens in order of groups, A's before B's; the last of each side of a group ends it
    a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_stop, b_stop = np.append(a_cut[1:], len(a)), np.append(b_cut[1:], len(b))
    a_last[a_stop - 1] = b_last[b_stop - 1] = 1
    in_order = np.empty(len(a) + len(b), object)
    in_order[np.arange(len(a)) + np.repeat(b_cut, a_stop - a_cut)] = _shown(len(v.a_bytes), "|")[a + a_last * len(v.a_bytes)]
    in_order[np.arange(len(b)) + np.repeat(a_stop, b_stop - b_cut)] = _shown(len(v.b_bytes), ";")[b + b_last * len(v.b_bytes)]
    shown = in_order.tolist()
    l_at = np.concatenate([[0], np.searchsorted(ends, stops) + 1]) * 4
    at = np.stack([a_at, a_at + b_at, l_at], 1).tolist()
    for (a0, t0, l0), (a1, t1, l1) in zip(at, at[1:]):
        yield (a1 - a0, "".join(shown[t0:t1]), links[l0:l1])


class Memo:
    """The parts of the last documents; of about `known` parts at most, those that came up latest."""

    def __init__(self, known: int) -> None:
        self.half, self.young, self.old = known // 2, {}, {}

    def add(self, parts: set[str], v: Vocabularies) -> dict[str, Part]:
        """Alignments, those of `parts` among them."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        new = parts.difference(self.young)
        again = new.intersection(self.old)
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        self.young.update(align_parts(list(new.difference(again)), v))
        return self.young

    def drop(self, parts: set[str]) -> None:
        for p in parts:
            del self.young[p]


@lru_cache(maxsize=1)
def _memo(a_path: str, b_path: str, known: int) -> Memo:
    """A Python worker's own."""
    return Memo(known)


def _align_batches(batches: Iterator[pa.RecordBatch], v: Vocabularies, memo: Memo, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            parts = [PART.findall(" " + text) if text else [] for text in some.column(1).to_pylist()]
            distinct = set(chain.from_iterable(parts))
            part = memo.add(distinct, v).__getitem__
            rows = []
            for own in parts:
                n_a, groups, links = zip(*map(part, own)) if own else ((), (), ())
                n, text, codes = sum(n_a), "".join(groups), b"".join(links)
                n_groups = text.count(";")
                # in a group of x and y tokens x + y - 1 pairs overlap
                rows.append((n, len(codes) // 4 + n_groups - n, n_groups, text[:-1], codes) if n >= 0 else (0, 0, 0, "", b""))
            memo.drop({p for p in distinct if len(p) > length})
            n_a, n_b, n_groups, groups, links = zip(*rows)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in links])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [some.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(groups), pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(links), "<i4"), pa.int32()))],
                ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", known: int = 200_000, length: int = 64) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links) for every row of `docs`.

    A encodes a space and the text, B the text, to which it adds that space.
    groups lists the ids of both in each group, as in `a1,a2|b1;a3|b2,b3`; links
    has a code for each pair of tokens whose bytes overlap, A's id times the size
    of B's vocabulary plus B's id.  Texts that are null or empty, or whose joined
    tokens in A or B aren't the text's bytes, have zeros, no groups and no links.
    Repeated rows come out as often as they went in; other columns are dropped.

    A Python worker keeps the alignments of at most about `known` parts of up to
    `length` characters, the latest, for its next documents.
    """
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _align_batches(batches, vocabularies(a_path, b_path), _memo(a_path, b_path, known), length)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(align, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, links array<int>")


def link_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best) of all links of `rows`: how many there are of each pair of ids, and whether no other pair of its B id has more."""
    totals = durable(rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    b = F.pmod("pair", F.lit(b_size))
    most = totals.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    # at most one row an id of B
    return totals.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", common: int = 300_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs`; see `aligned`.

    A link's count is the number of links of the same pair of ids in the whole
    table: n_best counts a document's links whose pair has the highest count of
    its B id (ties included), count_sum adds their counts.  The `common` most
    frequent pairs are broadcast with their counts; only links of the others
    meet them by a shuffle.  An empty table gives no rows.
    """
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = durable(
        aligned(docs, a_path, b_path, doc_id, text)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", groups, "links"), compression="zstd")
    known = durable(link_counts(rows, len(vocabularies(a_path, b_path).b_bytes)))
    top = durable(frequent(known, common).select(F.col("pair").alias("top"), F.col("n").alias("top_n"), F.col("best").alias("top_best")))
    links = rows.select("row", F.explode("links").alias("pair"))
    sums = lambda met, n, best: met.groupBy("row").agg(F.sum(n).alias("count_sum"), F.count_if(best).alias("n_best"))
    often = sums(links.join(F.broadcast(top), F.col("pair") == F.col("top")), "top_n", "top_best")
    rare = links.join(F.broadcast(top), F.col("pair") == F.col("top"), "left_anti").join(known, "pair")
    both = often.unionByName(sums(rare, "n", "best")).groupBy(F.col("row").alias("r")).agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256").join(both, F.col("row") == F.col("r"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
