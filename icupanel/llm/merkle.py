"""Merkle manifest of a dataset by time-forward processing, with a proof for every row.

Nodes are labelled by level and place, children before parents.  A sweep in
rising label order sends each digest to its parent through a priority queue; a
sweep in falling order sends each node's path to the root down to its children.
The queue is external and cut by label ranges: inside a block, the subtree of
arity**levels nodes, it is a heap; between blocks it is a table that Spark deals
by block and sorts by label, spilling to disk.  So no task holds more than a
block, however many rows a group has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from icupanel.llm.common import durable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and the siblings on both sides, level by level, give."""
    sides = F.arrays_zip(left.alias("l"), right.alias("r"))
    return F.aggregate(sides, leaf, lambda digest, s: F.sha2(F.concat(s["l"], digest, s["r"]), 256))


def _parents(n: int, arity: int) -> int:
    return -(-n // arity) if n > 1 else 1


def _joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def forward(nodes: list[tuple[int, str]], n: int, arity: int, levels: int) -> dict[tuple[int, int], list[str]]:
    """Children's digests of every inner node of a block, by (level, place); n > 1: nodes of the whole group at the level of `nodes`.

    A message in the queue is (level and place of the parent, place of the
    child, digest); all messages to the least label come off together.
    """
    sizes = [n]
    for _ in range(levels):
        sizes.append(_parents(sizes[-1], arity))
    queue = [(1, place // arity, place, digest) for place, digest in nodes]
    heapify(queue)
    children: dict[tuple[int, int], list[str]] = {}
    while queue:
        level, place, _, digest = heappop(queue)
        own = [digest]
        while queue and queue[0][:2] == (level, place):
            own.append(heappop(queue)[3])
        children[level, place] = own
        if level < levels and sizes[level] > 1:
            heappush(queue, (level + 1, place // arity, place, _joined(own)))
    return children


def backward(children: dict[tuple[int, int], list[str]], left: list[str], right: list[str], arity: int) -> Iterator[tuple[int, list[str], list[str]]]:
    """(place, left, right) of a block's lowest nodes: their siblings' joined digests level by level, then what came for the block's top.

    Labels fall, so a node's path is there before its children ask for it.
    """
    paths = {max(children): (left, right)}
    for level, place in sorted(children, reverse=True):
        left, right = paths.pop((level, place))
        own = children[level, place]
        for k in range(len(own)):
            path = ["".join(own[:k]), *left], ["".join(own[k + 1 :]), *right]
            if level == 1:
                yield place * arity + k, *path
            else:
                paths[level - 1, place * arity + k] = path


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[dict]]]:
    """Rows of each (gid, block), which lie one after the other."""
    rows = (r for batch in batches for r in batch.to_pylist())
    return ((key, list(own)) for key, own in groupby(rows, lambda r: (r["gid"], r["block"])))


def _dealt(nodes: DataFrame, size: int, *order: str) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / size)).repartition("gid", "block").sortWithinPartitions("gid", "block", *order)


def _climbed(leaves: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """The queue's tables (gid, place, n, digest) every `levels` levels, from the leaves up; n counts the group's nodes, and a group with one is done."""
    kind = "gid long, place long, n long, digest string"
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (gid, block), rows in _blocks(batches):
            n = rows[0]["n"]
            children = forward([(r["place"], r["digest"]) for r in rows], n, arity, levels)
            for _ in range(levels):
                n = _parents(n, arity)
            yield pa.RecordBatch.from_pylist([{"gid": gid, "place": block, "n": n, "digest": _joined(children[max(children)])}], schema)

    tables, most = [leaves], leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        nodes = tables[-1].where("n > 1").select("gid", "place", "n", "digest")
        tables.append(durable(_dealt(nodes, arity**levels, "place").mapInArrow(up, kind)))
        for _ in range(levels):
            most = _parents(most, arity)
    return tables


def _tops(tables: list[DataFrame]) -> DataFrame:
    """(gid, top) of every group: the nodes that are alone at their level."""
    out = None
    for t in tables:
        alone = t.where("n = 1").select("gid", F.col("digest").alias("top"))
        out = alone if out is None else out.unionByName(alone)
    return out


def _descended(tables: list[DataFrame], paths: DataFrame, arity: int, levels: int) -> DataFrame:
    """The lowest table with left, right and top of every node, from (gid, left, right, top) of the groups.

    Each block gets one message, the path of its own top; messages sort before
    the block's nodes.
    """
    out = None
    for k in range(len(tables) - 1, -1, -1):
        nodes = tables[k]
        names = nodes.columns
        done = nodes.where("n = 1").join(paths, "gid").select(*names, "left", "right", "top")
        if out is None:
            out = done
            continue
        kind = StructType([*nodes.schema.fields, *out.select("left", "right", "top").schema.fields])
        schema = to_arrow_schema(kind)

        def down(batches: Iterator[pa.RecordBatch], schema=schema) -> Iterator[pa.RecordBatch]:
            for (gid, block), (message, *rows) in _blocks(batches):
                if message["digest"] is not None:
                    raise ValueError(f"block {block} of group {gid} got no path")
                children = forward([(r["place"], r["digest"]) for r in rows], rows[0]["n"], arity, levels)
                found = backward(children, message["left"], message["right"], arity)
                yield pa.RecordBatch.from_pylist([r | {"left": left, "right": right, "top": message["top"]} for r, (_, left, right) in zip(rows, sorted(found), strict=True)], schema)

        sent = out.select("gid", (F.col("place") * arity**levels).alias("place"), "left", "right", "top")
        both = nodes.where("n > 1").unionByName(sent, allowMissingColumns=True).withColumn("known", F.col("digest").isNotNull())
        met = _dealt(both, arity**levels, "known", "place")
        out = met.mapInArrow(down, kind).unionByName(done)
        if k:
            out = durable(out)
    return out


def _indexed(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """`rows` in order, nulls first, with _part and _at, and (_part, _before): rows before each partition.  Equal rows may change places."""
    at = F.monotonically_increasing_id()
    by = [F.asc_nulls_first(c) for c in order]
    kept = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at))
    kept = kept.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept, parts.select(F.col("_part").alias("_p"), before.alias("_before"))


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with gid, the place of their group among all groups, place, their own in the group, and n, the group's size.

    Rows are dealt by ranges, so a hot group lies in many partitions; only the
    runs, one row for each group in each partition, are ranked and joined back
    by group and partition.
    """
    kept, parts = _indexed(rows, group, *order)
    runs = kept.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_q")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = durable(runs.join(F.broadcast(parts), F.col("_q") == F.col("_p")).select("_g", "_q", (F.col("_before") + F.col("_first")).alias("_start"), "_before", "_n"))
    groups = runs.groupBy(F.col("_g").alias("_h")).agg(F.min("_start").alias("_low"), F.sum("_n").alias("n"))
    ranked, before = _indexed(groups, "_h")
    gids = ranked.join(F.broadcast(before), F.col("_part") == F.col("_p")).select("_h", "_low", "n", (F.col("_before") + F.col("_at")).alias("gid"))
    known = runs.join(gids, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_q", (F.col("_before") - F.col("_low")).alias("_shift"), "n", "gid")
    met = kept.join(known, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_q")))
    return met.select(*rows.columns, "gid", (F.col("_at") + F.col("_shift")).alias("place"), "n")


def manifest(docs: DataFrame, also: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", arity: int = 16, levels: int = 2) -> DataFrame:
    """(order, group, the columns `also`, leaf, left, right, subroot, root) for every row of `docs`.

    A row's leaf is the digest of its fields; leaves of a group ascend by
    `order` (null first, then by leaf), groups by name (null first).  left and
    right hold the siblings' joined digests at each level up to the root, so
    `folded(leaf, left, right)` is the root.  `also` holds expressions over the
    columns of `docs`, computed while it is read once.

    Null and empty values have different leaves.  Repeated rows are leaves each
    for itself; which of them takes which place is left open, as their leaves
    are equal.  Ties in `order` go by leaf.  An empty table gives no rows.
    Other columns are dropped, whatever their names.
    """
    rows = docs.select(
        F.struct(F.col(order).alias("order"), F.col(group).alias("group"), *[c.alias(f"also_{k}") for k, c in (also or {}).items()]).alias("row"), leaf_digest([F.col(c) for c in fields]).alias("digest"))
    leaves = placed(rows.select("row", "digest", F.col("row.group").alias("group"), F.col("row.order").alias("order")), "group", "order", "digest")
    leaves = durable(leaves.select("gid", "place", "n", "digest", "row"))
    tables = _climbed(leaves, arity, levels)
    tops = durable(_tops(tables))
    n = tops.count()
    # the groups' tops are the leaves of one tree more
    over = _climbed(tops.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("place"), F.lit(n).cast("long").alias("n"), F.col("top").alias("digest"), F.col("gid").alias("of")), arity, levels)
    root = _tops(over).select("gid", "top")
    none = F.array().cast("array<string>")
    paths = durable(_descended(over, root.select("gid", none.alias("left"), none.alias("right"), "top"), arity, levels).select(F.col("of").alias("gid"), "left", "right", F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top")))
    return _descended(tables, paths, arity, levels).select(
        F.col("row.order").alias(order), F.col("row.group").alias(group), *[F.col(f"row.also_{k}").alias(k) for k in also or {}], F.col("digest").alias("leaf"), "left", "right", F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"))
