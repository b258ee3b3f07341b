"""Token counts without token ids: pieces are counted once per distinct pre-token.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum
over its pre-tokens of their piece counts.  Splitting, frequencies and the join
are Spark's; only the distinct pre-tokens meet the tokenizer library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icupanel.llm.common import durable

#: Fixed value: the characters of the Unicode property White_Space.
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Fixed value: the byte-level pre-tokenizer's split pattern, contractions in one branch and runs without backtracking.
PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}++| ?\p{{N}}++| ?[^{SPACE}\p{{L}}\p{{N}}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def added_tokens(path: str) -> list[str]:
    """The file's added tokens, which are matched in a text before it is split; raises for other kinds of tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space is counted by pre-tokens")
    return sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)


def _quoted(token: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in token)


def pre_tokens(text: Column, added: list[str]) -> Column:
    """The array of a text's pre-tokens, added tokens as themselves; null texts have none."""
    find = lambda part: F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    if not added:
        return find(text)
    any_of = "|".join(map(_quoted, added))
    with_added = F.concat(F.regexp_extract_all(text, F.lit(any_of), F.lit(0)), F.flatten(F.transform(F.split(text, any_of), find)))
    return F.when(F.greatest(*[F.instr(text, t) for t in added], F.lit(0)) > 0, with_added).otherwise(find(text))


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(piece, n, pieces): each distinct pre-token of all texts, its frequency and its piece count."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path).encode_batch
        for batch in batches:
            strings = batch.column(0).to_pylist()
            n = [len(e.ids) for at in range(0, len(strings), 4096) for e in encode(strings[at : at + 4096], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], ["piece", "n", "pieces"])

    totals = docs.select(F.explode(pre_tokens(F.col(text), added_tokens(path))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    return totals.mapInArrow(pieces, "piece string, n long, pieces int")


def frequent(known: DataFrame, most: int) -> DataFrame:
    """The pre-tokens above the lowest frequency that leaves at most `most` of them.

    Frequencies are cut at a few hundred logarithmic steps, so finding the cut
    needs one small histogram and no sort.
    """
    step = F.floor(F.log("n") * 16).cast("int")
    steps = known.groupBy(step.alias("step")).agg(F.count("*").alias("size")).orderBy(F.desc("step")).collect()
    least, room = None, most
    for r in steps:
        room -= r["size"]
        if room < 0:
            break
        least = r.step
    return known.where(F.lit(False) if least is None else step >= least)


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512, common: int = 300_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs`.

    Each distinct pre-token is encoded once.  The at most `common` most frequent
    ones are broadcast with their piece counts; the frequencies of all others
    are joined to the vocabulary by a shuffle.  Null and empty texts have no
    bytes and tokens.  Repeated rows come out as often as they went in; rows of
    one doc_id, null included, with different texts are counted apart.  Other
    columns are dropped.
    """
    added = added_tokens(path)
    known = durable(vocabulary(docs, path, text))
    top = durable(frequent(known, common).select(F.col("piece").alias("top_piece"), F.col("pieces").alias("top_pieces")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = ["doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")]
    base = rows.select(*key, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).groupBy("doc_id", "hash").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("copies"))
    # split first, then explode: an expression beside explode would be computed for every piece
    spread = rows.select(*key, pre_tokens(F.col("text"), added).alias("split")).select("doc_id", "hash", F.explode("split").alias("piece"))
    known_sums = (
        spread.join(F.broadcast(top), F.col("piece") == F.col("top_piece"))
        .groupBy(F.col("doc_id").alias("d0"), F.col("hash").alias("h0")).agg(F.sum("top_pieces").alias("common")))
    rare = (
        spread.join(F.broadcast(top), F.col("piece") == F.col("top_piece"), "left_anti")
        .repartition("piece")
        .groupBy("piece", "doc_id", "hash").agg(F.count("*").alias("n"))
        .join(known.select("piece", "pieces"), "piece")
        .groupBy(F.col("doc_id").alias("d1"), F.col("hash").alias("h1")).agg(F.sum(F.col("n") * F.col("pieces")).alias("rare")))
    same = lambda k: F.col("doc_id").eqNullSafe(F.col(f"d{k}")) & (F.col("hash") == F.col(f"h{k}"))
    sums = base.join(known_sums, same(0), "left").join(rare, same(1), "left")
    total = (F.coalesce("common", F.lit(0)) + F.coalesce("rare", F.lit(0))) / F.col("copies")
    counted = sums.withColumn("n_tokens", F.round(total).cast("long"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
