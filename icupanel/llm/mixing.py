"""Poisson replication: mix sources to target weights by repeating documents.

The mean repetition rate of a source is its target bytes over its actual bytes.
Each document's count inverts the Poisson distribution of that mean at a
uniform number hashed from seed and doc_id, so a rerun, a retried task or
another partitioning draws the same corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icupanel.llm.common import beside, durable

#: A mean above this is drawn as a sum of equal parts, each with its own hash, as exp(-mean) would vanish.
LARGEST_MEAN = 256.0


def uniform(seed: int, draw: Column, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, bucket: str, text: str, weights: dict[str, float] | None, temperature: float, budget: float) -> DataFrame:
    """(bucket, rate): target over actual bytes of each bucket.

    Without weights the target share is (actual share) ** temperature,
    renormalised; buckets that `weights` doesn't name get 0.  `budget` is the
    size of the mix as a multiple of the input.
    """
    sizes = docs.groupBy(F.col(bucket).alias("bucket")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        wanted = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        wanted = F.lit(0.0)
        for name, w in weights.items():
            wanted = F.when(F.col("bucket").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(wanted)
    sized = sizes.withColumn("wanted", F.when(F.col("size") > 0, wanted).otherwise(0.0))
    whole = sized.agg(F.sum("wanted").alias("wanted"), F.sum("size").alias("size")).first()
    if not whole["wanted"]:
        return sized.select("bucket", F.lit(1.0).alias("rate"))
    share = F.col("wanted") / F.lit(float(whole["wanted"]))
    return sized.select("bucket", F.when(F.col("size") > 0, F.lit(budget * whole["size"]) * share / F.col("size")).otherwise(1.0).alias("rate"))


def distribution(rate: DataFrame) -> DataFrame:
    """`rate` with the number of draws and the Poisson distribution function of one draw."""
    return rate.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")).withColumn("mean", F.col("rate") / F.col("draws")).withColumn(
        "cdf",
        F.expr("""aggregate(sequence(1, cast(mean + 12 * sqrt(mean) + 24 as int)),
                  struct(exp(-mean) as p, exp(-mean) as c, array(exp(-mean)) as f),
                  (a, k) -> struct(a.p * mean / k as p, a.c + a.p * mean / k as c, concat(a.f, array(a.c + a.p * mean / k)) as f),
                  a -> a.f)"""))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, bucket: str = "source", doc_id: str = "doc_id", text: str = "text", temperature: float = 0.5, budget: float = 1.0, seed: int = 17, most_buckets: int = 10_000) -> DataFrame:
    """Copies of `docs` in random global order, with n_copies, copy_no and shuffle_key.

    A document comes out n_copies times, numbered from 0; shuffle_key is the
    hash that orders the whole mix, rising within each output file.  Buckets
    whose texts are all empty keep the rate 1.  A null bucket is a bucket; a
    null doc_id hashes as the word null; repeated rows draw the same count.  An
    empty table gives no rows.  Columns of those three names are replaced,
    all others come out as they are.

    The bucket table is broadcast after counting that it has at most
    `most_buckets` rows; with more it is joined by a shuffle.
    """
    names = [c for c in docs.columns if c not in ("n_copies", "copy_no", "shuffle_key")]
    table = durable(distribution(rates(docs, bucket, text, weights, temperature, budget)).select(F.col("bucket").alias("_bucket"), F.col("draws").alias("_draws"), F.col("cdf").alias("_cdf")))
    small = table.limit(most_buckets + 1).count() <= most_buckets
    joined = beside(docs.select(*names), id=F.col(doc_id), bucket=F.col(bucket)).join(F.broadcast(table) if small else table, F.col("bucket").eqNullSafe(F.col("_bucket")))
    draws = F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda i: uniform(seed, i, F.col("id")))
    more = joined.withColumn("_u", draws)
    counted = more.withColumn("n_copies", F.expr("aggregate(_u, 0, (n, u) -> n + size(filter(_cdf, c -> c <= u)))"))
    copies = counted.where("n_copies > 0").select("row", "id", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy_no"))
    key = F.concat_ws("|", F.lit(f"order{seed}"), F.col("copy_no").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    keyed = copies.select("row.*", "n_copies", "copy_no", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("shuffle_key"))
    # the text as well, as rows of one doc_id or without any share a shuffle_key
    return keyed.repartition("shuffle_key", F.xxhash64(text)).sortWithinPartitions("shuffle_key")
