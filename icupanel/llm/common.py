"""Helpers shared by the operators: tables, durable intermediates, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of `docs` in the struct `row`, beside `columns`; so no name of theirs can clash. `select("row.*")` gives them back."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="icupanel-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame, **options: str) -> DataFrame:
    """`df` computed once, as Parquet in the shared folder, and read back; removed when the session's JVM ends.

    Lost executors take nothing of it with them.  Unlike a checkpoint it doesn't
    carry Spark's estimates of size and its constraints along, which multiply
    from round to round of an iteration until planning takes longer than the work.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `edges`; component is its smallest node.

    Distributed union-find: every round each node takes the smallest label among
    its own and its neighbours', then follows that label's own label once
    (pointer jumping), so a chain of n nodes needs about log n rounds.  Labels
    stay in Spark; only the number of changed nodes reaches the driver.
    An empty edge table gives an empty result.
    """
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src != dst")
    both = durable(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = durable(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
        .select("node", F.least("node", "low").alias("component"))
    )
    while True:
        near = (
            both.join(labels, F.col("dst") == F.col("node"))
            .groupBy("src").agg(F.min("component").alias("near"))
        )
        hooked = (
            labels.join(near, F.col("node") == F.col("src"))
            .select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        )
        parents = labels.select(F.col("node").alias("parent"), F.col("component").alias("grand"))
        jumped = durable(
            hooked.join(parents, F.col("component") == F.col("parent"), "left")
            .select("node", "was", F.least("component", F.coalesce("grand", "component")).alias("component"))
        )
        changed = jumped.where("was != component").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after further links: components of the components that the links connect."""
    if labels is None:
        return connected_components(links)
    own = lambda c: labels.select(F.col("node").alias(f"n{c}"), F.col("component").alias(f"c{c}"))
    ends = links.join(own("a"), F.col("a") == F.col("na"), "left").join(own("b"), F.col("b") == F.col("nb"), "left")
    joined = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    up = joined.select(F.col("node").alias("from"), F.col("component").alias("to"))
    known = labels.join(up, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
    return durable(known.unionByName(joined.join(labels.select("node"), "node", "left_anti")))


def bucket_components(met: DataFrame, verify: Callable[[DataFrame], DataFrame], similarity: float, rounds: int = 2, block: int = 64, most_rounds: int = 2, first: DataFrame | None = None,
                      sketches: DataFrame | None = None, possible: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(node, component) of all links among ids that share a key; no pair is left out.

    `met` has (id, n, key), n the size of the id's set; `verify` takes distinct
    pairs (a, b) and returns those that are links.  Pairs whose sizes alone
    forbid the similarity aren't verified.  Where keys are elements of the sets
    in an order that all sets share, `at` is a key's place in its id's set, from
    0: under their first common key two sets can share no more than what follows
    it in either, which rules out most pairs that meet late.  Without `at` it is 0.

    Candidate pairs in `first`, found by another way, are verified before all
    others.  In the first rounds each member of a bucket meets two others of it,
    so that copies in large numbers are connected by few pairs: the one whose
    key comes first in its set, and one of another component.  Where all of a
    bucket are edited copies of one text, that text, or the least edited of
    them, has the fewest rare keys before a common one, so the copies near
    enough to be linked to it are so at once.  There are more than `rounds` of
    these rounds, up to `most_rounds`, while buckets hold many pairs of different components.  Then
    all such pairs are verified, in blocks of about `block` members, so that no
    task holds a whole large bucket.

    `sketches` has (id, …) and `possible` a condition on the columns of two ids,
    with n, under two prefixes, which is false only for pairs that can't be
    links.  It is part of the joins, so pairs that it rules out are neither stored nor verified.
    """
    bucket = Window.partitionBy("key")
    met = met if "at" in met.columns else met.withColumn("at", F.lit(0))
    ends = met.select("id", "n", "key", "at", F.min("id").over(bucket).alias("lo"), F.max("id").over(bucket).alias("hi"))
    met = durable(ends.where("lo < hi").select("id", "n", "key", "at").distinct())
    share = similarity / (1 + similarity)
    close = lambda x, y: F.least(F.col(f"{x}n") - F.col(f"{x}at"), F.col(f"{y}n") - F.col(f"{y}at")) >= F.lit(share) * (F.col(f"{x}n") + F.col(f"{y}n")) - F.lit(1e-6)
    tried = labels = None
    columns = [c for c in sketches.columns if c not in ("id", "n")] if sketches is not None else []
    may = possible if columns else lambda x, y: F.lit(True)

    def mixed(met: DataFrame, turn: int) -> DataFrame:
        """Members of buckets of several components, with c, their own, and two of the bucket's members: `near`, whose key comes first, and `two`, others each turn."""
        now = met.withColumn("c", F.col("id"))
        if labels is not None:
            own = labels.select(F.col("node").alias("id"), "component")
            now = met.join(own, "id", "left").select("id", "n", "key", "at", F.coalesce("component", "id").alias("c"))
        by = F.struct(F.xxhash64("c", F.lit(turn)).alias("order"), "c", F.xxhash64("id", F.lit(turn)).alias("draw"), "id", "n", "at")
        early = F.struct("at", F.xxhash64("id", F.lit(turn)).alias("draw"), "id", "n", "c")
        ends = now.groupBy("key").agg(F.min(by).alias("one"), F.max(by).alias("two"), F.min(early).alias("near"), F.count("*").alias("size")).where("one.c <> two.c")
        hub = lambda c: F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("id", "n", "at", "c")]).alias(c)
        return now.join(ends.select("key", hub("near"), hub("two"), "size"), "key")

    def with_hubs(live: DataFrame) -> DataFrame:
        each = live.select("id", "n", "at", "c", F.explode(F.array("near", "two")).alias("p")).where(F.col("c") != F.col("p.c"))
        pairs = each.where(close("", "p.")).select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
        if not columns:
            return pairs
        side = lambda x: sketches.select(F.col("id").alias(x), F.struct("n", *columns).alias(f"of_{x}"))
        return pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(may("of_a.", "of_b.")).select("a", "b")

    def many_left(live: DataFrame) -> bool:
        """Whether buckets hold more than eight pairs of different components a member."""
        own = live.groupBy("key", "c").agg(F.count("*").cast("double").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"))
        left = own.agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m") - F.col("same")).alias("pairs")).first()
        return (left.pairs or 0) > 16 * (left.m or 0)

    def all_pairs(live: DataFrame) -> DataFrame:
        blocks = F.ceil(F.col("size") / block).cast("int")
        own = ["id", "n", "at", "c", "key", *columns]
        whole = live.join(sketches.select("id", *columns), "id") if columns else live
        cut = whole.select(*own, blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("x"))
        dealt = cut.select(*own, "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
        dealt = dealt.select(*own, "x", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
        l, r = dealt.alias("l"), dealt.alias("r")
        same = (F.col("l.key") == F.col("r.key")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
        ours = (F.col("l.x") != F.col("r.x")) | (F.col("l.i") == F.col("l.j"))
        pairs = l.join(r, same & ours & (F.col("l.id") < F.col("r.id")) & (F.col("l.c") != F.col("r.c")) & close("l.", "r.") & may("l.", "r."))
        return pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))

    def settle(pairs: DataFrame) -> None:
        nonlocal tried, labels
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = durable(pairs)
        if labels is not None and pairs.isEmpty():
            return
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = _merged(labels, durable(verify(pairs)))

    if first is not None:
        settle(first)
    turn = 0
    while True:
        live = mixed(met, turn)
        if labels is not None:  # components only grow, so other buckets are done
            live = durable(live)
            met = live.select("id", "n", "key", "at")
        if turn >= rounds and (turn >= most_rounds or not many_left(live)):
            break
        settle(with_hubs(live))
        turn += 1
    settle(all_pairs(live))
    return labels
