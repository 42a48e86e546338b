"""Readers and writers of tab-separated tables, runs, truth, folds and logs.

Scans add ``ord``, a position that follows the order of the file; it stands where ties go by order of arrival.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.address import strip
from ..functions.text import clean_and_sort, split_ids

ID_COLUMN, MATCH_COLUMN, CANDIDATE_COLUMN = "source1_entity_id", "matched_entity_ids", "candidate_entity_ids"


def _with_order(df: DataFrame) -> DataFrame:
    return df.withColumn("ord", F.monotonically_increasing_id())


def last_of_each(df: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Of rows with the same key, the last."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def read_records(spark: SparkSession, path: str, id_column: str, source: str, name: str = "name", address: str = "address") -> DataFrame:
    """(id, source, raw_name, raw_address, ord) from a headed table with quotes; values stripped, last of equal ids."""
    rows = _with_order(spark.read.csv(path, sep="\t", header=True, quote='"', escape='"'))
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    rows = rows.select(text(id_column).alias("id"), F.lit(source).alias("source"), text(name).alias("raw_name"), text(address).alias("raw_address"), "ord")
    return last_of_each(rows.where("id <> ''"))


def read_entities(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """(id, name, address, country, ord) by position, without quotes; one country if asked for."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema="id string, name string, address string, country string")
    rows = _with_order(rows).select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "address", "country")), "ord")
    return rows.where(F.col("country") == country) if country else rows


def read_truth(spark: SparkSession, path: str, clean: bool = True, first: int | None = None) -> DataFrame:
    """(s1_id, matched_ids) from the first two columns, whatever their names; lists as they stand unless clean."""
    rows = spark.read.csv(path, sep="\t", header=True)
    a, b = rows.columns[:2]
    out = _with_order(rows).select(strip(F.col(a)).alias("s1_id"), split_ids(F.col(b)).alias("ids"), "ord")
    if first:
        out = out.orderBy("ord").limit(first)
    return out.where("s1_id <> ''").select("s1_id", (clean_and_sort(F.col("ids")) if clean else F.col("ids")).alias("matched_ids"))


def read_run(spark: SparkSession, path: str, column: str = "ids", header: bool = True) -> DataFrame:
    """(s1_id, ids) of a run file, in the file's order of ids."""
    rows = spark.read.csv(path, sep="\t", header=header, schema="s1_id string, ids string", quote="")
    return rows.select("s1_id", split_ids(F.col("ids")).alias(column))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, matched_ids) sorted and cleaned; empty or repeated ids are errors."""
    rows = read_run(spark, path).select(strip(F.coalesce("s1_id", F.lit(""))).alias("s1_id"), "ids")
    bad = rows.groupBy("s1_id").count().where("s1_id = '' or count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"Empty or repeated ids: {[r['s1_id'] for r in bad]}")
    return rows.select("s1_id", clean_and_sort(F.col("ids"), F.col("s1_id")).alias("matched_ids"))


def with_needed(targets: DataFrame, needed: DataFrame) -> DataFrame:
    """The targets whose id is needed."""
    return targets.join(needed.select("id").distinct(), "id", "left_semi")


def sampled(targets: DataFrame, needed: DataFrame, every: int = 3, rows: int = 300_000) -> DataFrame:
    """Needed targets, and every so many of the first rows; a sampling scan."""
    marked = targets.join(needed.select("id").distinct().withColumn("_needed", F.lit(True)), "id", "left")
    return marked.where(F.col("_needed").isNotNull() | ((F.col("ord") % every == 0) & (F.col("ord") <= rows))).drop("_needed")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources' records; of equal ids, that of the last source."""
    ranked = [s.withColumn("src_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return last_of_each(out, "id", "src_rank").drop("src_rank")


def submission_rows(run: DataFrame, expected: DataFrame, column: str = "matched_ids") -> DataFrame:
    """One row for each expected id in its order, null lists empty; ids that are missing or unexpected are errors."""
    missing = expected.select("s1_id").join(run, "s1_id", "left_anti")
    if n := missing.count():
        raise ValueError(f"Missing predictions for {n} expected ids, such as {[r[0] for r in missing.select('s1_id').limit(5).collect()]}")
    extra = run.select("s1_id").join(expected, "s1_id", "left_anti")
    if n := extra.count():
        raise ValueError(f"Extraneous {n} ids, such as {[r[0] for r in extra.limit(5).collect()]}")
    return expected.select("s1_id", "ord").join(run.select("s1_id", column), "s1_id", "left").select("s1_id", F.coalesce(column, F.array().cast("array<string>")).alias(column), "ord")


def write_run(run: DataFrame, expected: DataFrame, path: str, column: str = "matched_ids", clean: bool = True, single: bool = True) -> None:
    """A headed file of id and comma-joined list in the expected order; sorted lists without the own id if clean."""
    rows = submission_rows(run, expected, column)
    ids: Column = clean_and_sort(F.col(column), F.col("s1_id")) if clean else F.col(column)
    header = MATCH_COLUMN if column == "matched_ids" else CANDIDATE_COLUMN
    out = rows.orderBy("ord").select(F.col("s1_id").alias(ID_COLUMN), F.array_join(ids, ",").alias(header))
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_stage(df: DataFrame, path: str, expected_rows: int, by: str = "country") -> DataFrame:
    """A stage's rows as Parquet, partitioned; one that is there with the expected number of rows is used again."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.parquet(path)
        if old.count() == expected_rows:
            return old
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return spark.read.parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """A table that several steps read, as compressed Parquet in spark.checkpoint.dir, where cached blocks take several times the disk.

    Without that folder it goes to a temporary one if the session runs in one process, and else to the cache.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            return df.persist()
        folder = f"file://{tempfile.mkdtemp(prefix='linkwright-')}"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
