"""Readers and writers: panels, per-patient files, prediction documents, splits, results."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID, TIME = "stay_id", "stay_time"
#: Ids up to this many are pushed to the scan as a list; more are joined.
PUSHED_IDS = 1000


def read_panel(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load(spark: SparkSession, path: str, ids: Sequence[int] | DataFrame | None = None, where: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of the given stays that meet `where`; short id lists and the predicate reach the scan."""
    df = spark.read.parquet(path)
    if isinstance(ids, DataFrame):
        df = df.join(ids.select(ID).distinct(), ID, "left_semi")
    elif ids is not None:
        df = df.where(F.col(ID).isin(*ids)) if len(ids) <= PUSHED_IDS else df.join(spark.createDataFrame([(i,) for i in ids], f"{ID} long"), ID, "left_semi")
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def one_stay(spark: SparkSession, path: str, stay: int) -> DataFrame:
    """One stay's rows in time order; files sorted by `write_panel` let the scan skip all other row groups."""
    rows = spark.read.parquet(path).where(F.col(ID) == stay)
    return rows.repartition(1).sortWithinPartitions(TIME)  # one stay's rows; orderBy would scan twice to find ranges


def write_panel(df: DataFrame, path: str, mode: str = "error", rows_a_group: int = 2000) -> None:
    """Files sorted by stay and time, in row groups of at most `rows_a_group` rows, so that statistics lead to one stay's groups."""
    df.repartitionByRange(ID).sortWithinPartitions(ID, TIME).write.mode(mode).option("parquet.block.row.count.limit", rows_a_group).parquet(path)


def write_split_cache(df: DataFrame, path: str, by: Sequence[str] = ("split", "rep")) -> None:
    df.repartition(*by, ID).write.partitionBy(*by).parquet(path)


def read_psv(spark: SparkSession, path: str, schema: str, id_pattern: str = r"p(\d+)\.psv$") -> DataFrame:
    """Pipe-separated files of one patient each, the id parsed from the file's path by `id_pattern`; NaN is missing.

    Many folders are listed by a few tasks a core: Spark's default is a task a folder.
    """
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        df = spark.read.csv(path, sep="|", header=True, schema=schema, nullValue="NaN", nanValue="", recursiveFileLookup=True)
    finally:
        spark.conf.set(tasks, before)
    return df.withColumn(ID, F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).cast("long"))


def write_psv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One folder a patient with pipe-separated rows in time order."""
    df.select(ID, TIME, *columns).repartition(ID).sortWithinPartitions(ID, TIME).write.partitionBy(ID).csv(path, sep="|", header=True, nullValue="NaN")


def to_documents(rows: DataFrame, keys: Sequence[str], rows_a_document: int = 100_000) -> DataFrame:
    """Prediction documents: for each run, ids and ragged lists of times, labels and scores, a stay each.

    A run's stays are dealt by hash over as many documents as keep each near
    `rows_a_document` rows if all rows were of one run; a stay is never parted.
    """
    chunks = max(1, -(-rows.count() // rows_a_document))
    per = rows.groupBy(*keys, ID).agg(F.sort_array(F.collect_list(F.struct(TIME, "label", "score"))).alias("r"))
    one = per.groupBy(*keys, F.pmod(F.xxhash64(ID), F.lit(chunks)).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct(ID, "r"))).alias("d"))
    ragged = lambda c: F.transform("d", lambda s: F.transform(s["r"], lambda r: r[c]))
    return one.select(*keys, F.transform("d", lambda s: s[ID]).alias("ids"), ragged(TIME).alias("times"), ragged("label").alias("labels"), ragged("score").alias("scores"))


def from_documents(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long rows of prediction documents, the lists walked in step."""
    stays = documents.select(*keys, F.explode(F.arrays_zip("ids", "times", "labels", "scores")).alias("s"))
    rows = stays.select(*keys, F.col("s.ids").alias(ID), F.explode(F.arrays_zip("s.times", "s.labels", "s.scores")).alias("r"))
    return rows.select(*keys, ID, F.col("r.times").alias(TIME), F.col("r.labels").alias("label"), F.col("r.scores").alias("score"))


def read_documents(spark: SparkSession, path: str, keys: dict[str, str], whole_files: bool = True) -> DataFrame:
    """Long rows of prediction documents: a document a file, or a line each without `whole_files`."""
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", ids array<long>, times array<array<double>>, labels array<array<double>>, scores array<array<double>>"
    return from_documents(spark.read.json(path, schema=schema, multiLine=whole_files), list(keys))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(stay_id, split, rep) of a split document: total, dev.split_k.{train,validation} and test.split_k."""
    doc = spark.read.json(path, multiLine=True)
    parts = []
    for name in doc.schema["dev"].dataType.names:
        if m := re.fullmatch(r"split_(\d+)", name):
            parts += [(f"dev.{name}.{s}", s, int(m[1])) for s in doc.schema["dev"].dataType[name].dataType.names]
    parts += [(f"test.{n}", "test", int(m[1])) for n in doc.schema["test"].dataType.names if (m := re.fullmatch(r"split_(\d+)", n))]
    each = F.explode(F.array(*[F.struct(F.col(p).alias("ids"), F.lit(s).alias("split"), F.lit(r).alias("rep")) for p, s, r in parts]))
    return doc.select(each.alias("e")).select(F.explode("e.ids").alias(ID), "e.split", "e.rep")


def write_splits(splits: DataFrame, path: str) -> None:
    """(stay_id, label, rep, split) as JSON lines: no list of all ids is ever one row."""
    write_json(splits.select(ID, "label", "rep", "split"), path)


def read_split_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=f"{ID} long, label int, rep int, split string")


def write_evaluation(table: DataFrame, path: str, run: dict[str, str]) -> None:
    """An evaluation table, a line a threshold, under the keys of its run."""
    write_json(table.select(*[F.lit(v).alias(k) for k, v in run.items()], *table.columns), path)


def read_evaluation(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def write_statistics(stats: DataFrame, path: str) -> None:
    """(column, mean, std, missing, share) as JSON lines."""
    write_json(stats.select("column", "mean", "std", "missing", "share"), path)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="column string, mean double, std double, missing long, share double")


def registry(spark: SparkSession, folder: str) -> dict[str, str]:
    """Each source's newest path in a folder of paths named like source_1.2.0, with or without .parquet; other names are passed over."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)
    paths = {f.getPath().getName().removesuffix(".parquet"): f.getPath().toString() for f in found}
    return {source: paths[name] for source, name in newest(list(paths)).items()}


def open_source(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """The newest version of a registered source; raises for an unknown one."""
    known = registry(spark, folder)
    if source not in known:
        raise ValueError(f"no source {source} in {folder}; there are {', '.join(sorted(known))}")
    return spark.read.parquet(known[source])


def newest(names: Sequence[str]) -> dict[str, str]:
    """Of names like source_1.2.0, each source's newest version."""
    found: dict[str, tuple[tuple[int, ...], str]] = {}
    for n in names:
        if m := re.fullmatch(r"(.+)_(\d+(?:\.\d+)*)", n):
            key = tuple(map(int, m[2].split(".")))
            found[m[1]] = max(found.get(m[1], ((), "")), (key, n))
    return {k: v for k, (_, v) in found.items()}


def union_sources(tables: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All tables' rows under all their columns, with the name of the table each row is from."""
    out = None
    for name, df in tables.items():
        one = df.withColumn(source, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def flatten_runs(runs: DataFrame, keys: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """(…keys, split, metric, value): structs of metrics by split, lists left out."""
    parts = []
    for s in splits:
        for f in runs.schema[s].dataType.fields:
            if f.dataType.typeName() in ("double", "long", "integer", "float"):
                parts.append(F.struct(F.lit(s).alias("split"), F.lit(f.name).alias("metric"), F.col(f"{s}.{f.name}").cast("double").alias("value")))
    return runs.select(*keys, F.explode(F.array(*parts)).alias("r")).select(*keys, "r.*")


def index_results(spark: SparkSession, path: str, keys: Sequence[str], whole_files: bool = True) -> DataFrame:
    """Keys of result documents and the files that hold them: a document a file, or a line each without `whole_files`."""
    return spark.read.json(path, multiLine=whole_files).select(*keys, F.col("_metadata.file_path").alias("file")).groupBy(*keys).agg(F.sort_array(F.collect_set("file")).alias("files"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; not-a-number becomes null."""
    clean = {c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    df.withColumns(clean).write.json(path)


def write_normaliser(stats: DataFrame, path: str) -> None:
    """(column, mean, std) as JSON lines; a column without values has null for both."""
    write_json(stats.select("column", "mean", "std"), path)


def read_normaliser(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="column string, mean double, std double")


def write_weights(weights: DataFrame, path: str, keys: Sequence[str]) -> None:
    """The prevalence weight (`lambda`) of each key, as JSON lines."""
    write_json(weights.select(*keys, "lambda"), path)


def read_weights(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    return spark.read.json(path, schema=", ".join(f"{k} {t}" for k, t in keys.items()) + ", lambda double")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
