"""Histogram sort: exact, byte-balanced shards after one exchange.

Rows are ordered by (hash of the text, doc_id, number among equal keys).  Splitters are found by counting
the exact bytes between candidate keys over all partitions and refining the
candidates around each target until every splitter is within tolerance; then
each row is placed by its splitters and rows move once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icupanel.llm.common import beside, durable

HASH_BITS = 60
TOP_BITS = 12
LOWEST = -(1 << 63)


def text_hash(text: Column) -> Column:
    """The first 60 bits of the text's MD5, so that equal texts are neighbours."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def byte_size(text: Column, overhead: int) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


@dataclass(frozen=True)
class Cell:
    """Rows between two candidate keys: their bytes and count, and what lies below."""

    size: int
    rows: int
    low_h: int
    high_h: int
    low_id: int
    high_id: int
    below: int
    rows_below: int

    @property
    def single(self) -> bool:
        return self.low_h == self.high_h and self.low_id == self.high_id

    @property
    def key(self) -> tuple[int, int, int]:
        return (self.low_h, self.low_id if self.low_h == self.high_h else LOWEST, 0)

    @property
    def end(self) -> tuple[int, int, int]:
        return (self.high_h, self.high_id + 1, 0) if self.low_h == self.high_h else (self.high_h + 1, LOWEST, 0)


def _sums() -> list[Column]:
    return [F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("h").alias("low_h"), F.max("h").alias("high_h"), F.min("id").alias("low_id"), F.max("id").alias("high_id")]


def _stacked(rows: list, below: int, rows_below: int) -> list[Cell]:
    out = []
    for r in rows:
        out.append(Cell(r["size"], r["rows"], r.low_h, r.high_h, r.low_id, r.high_id, below, rows_below))
        below, rows_below = below + r["size"], rows_below + r["rows"]
    return out


def find_splitters(keys: DataFrame, parts: int, tolerance: int = 0, probes: int = 64) -> tuple[list[tuple[int, int, int]], list[int], list[tuple[int, int]]]:
    """Splitter keys (h, id, number) between `parts` parts, the rows below each, and the (h, id) that splitters part.

    `keys` holds h, id and size.  A splitter is accepted at a candidate key
    within `tolerance` bytes of its target; with 0 it is refined to the document
    that straddles the target and put on that document's nearer side (a tie goes
    below it).  Rows equal in h and id, whose texts and so sizes are equal, are
    counted off: those with a number below the splitter's lie below it.  The
    driver holds at most 4096 + parts * probes sums a round.
    """
    shift = HASH_BITS - TOP_BITS
    first = keys.groupBy(F.shiftright("h", shift).alias("top")).agg(*_sums()).orderBy("top").collect()
    cells = _stacked(first, 0, 0)
    if not cells:
        return [], [], []
    total, count = cells[-1].below + cells[-1].size, cells[-1].rows_below + cells[-1].rows
    end = ((1 << HASH_BITS, LOWEST, 0), count)
    targets = list(range(1, parts))  # of total / parts each, kept as numerators
    where = {}
    at = 0
    for k in targets:
        while at + 1 < len(cells) and cells[at + 1].below * parts <= k * total:
            at += 1
        where[k] = cells[at]
    done: dict[int, tuple[tuple[int, int, int], int]] = {}
    parted: set[tuple[int, int]] = set()

    def settle(k: int) -> bool:
        cell = where[k]
        left, right = k * total - cell.below * parts, (cell.below + cell.size) * parts - k * total
        if min(left, right) > tolerance * parts and not cell.single:
            return False
        some = 0
        if cell.single and cell.rows > 1:
            one = cell.size // cell.rows * parts
            some = max(0, -(-(2 * left - one) // (2 * one)))  # rows whose middle lies before the target
        if 0 < some < cell.rows:
            parted.add((cell.low_h, cell.low_id))
            done[k] = ((cell.low_h, cell.low_id, some), cell.rows_below + some)
        elif left <= right:
            done[k] = (cell.key, cell.rows_below)
        else:
            done[k] = (cell.end, cell.rows_below + cell.rows)
        return True

    pending = [k for k in targets if not settle(k)]
    spark = keys.sparkSession
    while pending:
        opened = list(dict.fromkeys(where[k] for k in pending))
        number = {c: i for i, c in enumerate(opened)}
        spans = spark.createDataFrame(
            [(i, c.low_h >> shift, c.low_h, c.high_h, c.low_id, c.high_id,
              ((c.high_h - c.low_h) if c.low_h < c.high_h else (c.high_id - c.low_id)) // probes + 1) for i, c in enumerate(opened)],
            "span int, top long, low_h long, high_h long, low_id long, high_id long, step long",
        )
        inside = keys.withColumn("top", F.shiftright("h", shift)).join(F.broadcast(spans), "top").where(
            F.col("h").between(F.col("low_h"), F.col("high_h"))
            & ((F.col("low_h") < F.col("high_h")) | F.col("id").between(F.col("low_id"), F.col("high_id"))))
        probe = F.when(F.col("low_h") < F.col("high_h"), F.expr("(h - low_h) div step")).otherwise(F.expr("(cast(id as decimal(20, 0)) - low_id) div step"))
        sums = inside.select("span", probe.alias("probe"), "h", "id", "size").groupBy("span", "probe").agg(*_sums()).orderBy("span", "probe").collect()
        refined: dict[int, list] = {}
        for r in sums:
            refined.setdefault(r.span, []).append(r)
        stacks = {i: _stacked(rows, opened[i].below, opened[i].rows_below) for i, rows in refined.items()}
        for k in pending:
            stack = stacks[number[where[k]]]
            where[k] = max((c for c in stack if c.below * parts <= k * total), key=lambda c: c.below)
        pending = [k for k in pending if not settle(k)]
    ordered = [done.get(k, end) for k in targets]
    return [key for key, _ in ordered], [rows for _, rows in ordered], sorted(parted)


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with no, their number among rows equal in h and id.

    Rows are written once, in whatever partitions they come, and numbered there;
    only the counts by key and partition are summed up.
    """
    kept = durable(rows.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    turn = F.row_number().over(Window.partitionBy("h", "id", "part").orderBy("at"))
    before = Window.partitionBy("h", "id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy("h", "id", "part").agg(F.count("*").alias("n")).select("h", "id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return kept.withColumn("turn", turn).join(counts, ["h", "id", "part"]).select(*rows.columns, (F.col("before") + F.col("turn") - 1).alias("no"))


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", overhead: int = 16, tolerance: float = 0.0, blocks: int | None = None, block_bytes: int = 1 << 30, most_blocks: int = 256) -> DataFrame:
    """`docs` with size, shard (0 to shards - 1) and slot (gapless from 0 in a shard).

    Sizes are UTF-8 bytes plus `overhead`; shards are equal in bytes to within
    `tolerance` (a share of the mean shard), or to the nearest document at 0.
    Equal texts are neighbours and only parted where a splitter has to fall
    inside their group, so a hot group is split, not piled up.  Each shard is
    built from `blocks` blocks, each a window partition of its own, by default of
    about `block_bytes` bytes, but 8 to `most_blocks` a shard; slots follow the
    key order.  Null texts count as empty; a null doc_id sorts first; rows
    equal in text and doc_id may come in any order and are dealt by count where
    a splitter falls among them.  An empty table gives no rows.  Columns named
    size, shard or slot are replaced, all others come out as they are.
    """
    names = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    hashed = beside(docs.select(*names), h=text_hash(F.col(text)), id=F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST + 1)), size=byte_size(F.col(text), overhead))
    keys = durable(hashed.select("h", "id", "size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    blocks = blocks or min(most_blocks, max(8, -(-total // (shards * block_bytes))))
    parts = shards * blocks
    splitters, below, parted = find_splitters(keys, parts, int(tolerance * total / shards))
    base = docs.sparkSession.createDataFrame(
        [(k, (below[k - 1] if k else 0) - (below[k // blocks * blocks - 1] if k >= blocks else 0)) for k in range(parts if splitters else 0)],
        "block int, base long")
    numbered = hashed.withColumn("no", F.lit(0).cast("long"))
    if parted:
        # one row a splitter at most
        hot = F.broadcast(docs.sparkSession.createDataFrame(parted, "h long, id long"))
        numbered = numbered.join(hot, ["h", "id"], "left_anti").unionByName(_numbered(hashed.join(hot, ["h", "id"], "left_semi")))
    return _place(numbered, splitters, base, blocks)


def _place(rows: DataFrame, splitters: list[tuple[int, int, int]], base: DataFrame, blocks: int) -> DataFrame:
    shift = HASH_BITS - TOP_BITS
    by_top: dict[int, list[tuple[int, int, int]]] = {}
    for s in splitters:
        by_top.setdefault(min(s[0] >> shift, (1 << TOP_BITS) - 1), []).append(s)
    table, passed = [], 0
    for top in range(1 << TOP_BITS):
        own = by_top.get(top, [])
        table.append((top, passed, own))
        passed += len(own)
    lookup = rows.sparkSession.createDataFrame(table, "top long, passed int, own array<struct<h: long, id: long, no: long>>")
    below = F.expr("size(filter(own, s -> s.h < h or (s.h = h and (s.id < id or (s.id = id and s.no <= no)))))")
    placed = (
        rows.withColumn("top", F.shiftright("h", shift))
        .join(F.broadcast(lookup), "top", "left")  # 4096 rows, whatever the data
        .select("row", "h", "id", "no", "size", (F.col("passed") + below).alias("block"))
    )
    order = Window.partitionBy("block").orderBy("h", "id", "no")
    met = placed.withColumn("turn", F.row_number().over(order).cast("long")).join(F.broadcast(base), "block")  # one row a block
    return met.select("row.*", "size", F.expr(f"cast(block div {blocks} as int)").alias("shard"), (F.col("turn") - 1 + F.col("base")).alias("slot"))
