"""Records from the test tables: parts and documents as anchors and two target tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens


def _third(key: str):
    return F.element_at(F.array(F.lit("s1"), F.lit("s2"), F.lit("s3")), (F.col(key) % 3 + 1).cast("int"))


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, country, name, address, ord): names that collide a lot, in one country for each brand."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat_ws(" ", "p_name", "p_type")
    address = F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"), F.lit(" street, "), F.col("p_brand"), F.lit(" tx"))
    return part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), _third("p_partkey").alias("source"), F.col("p_brand").alias("country"), name.alias("name"), address.alias("address"), F.col("p_partkey").alias("ord"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, country, name, address, ord): five words as a name, seven as an address."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = tokens(F.col("text"))
    return docs.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), _third("doc_id").alias("source"), F.col("lang").alias("country"), F.array_join(F.slice(w, 1, 5), " ").alias("name"), F.array_join(F.slice(w, 6, 7), " ").alias("address"), F.col("doc_id").alias("ord"))


def split_sources(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors, and targets of both tables."""
    return records.where("source = 's1'"), records.where("source <> 's1'")
