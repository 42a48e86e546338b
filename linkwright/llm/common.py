"""What several operators share: the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java's, Python's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes up to which a table may go to every executor.
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, where the optimizer would repeat it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the session runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='corpus-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: short lineage, computed once, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what saved() wrote, once nothing reads it."""
    jvm, path = df.sparkSession._jvm, df.saved_path
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def hinted(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, to be broadcast if its rows of about row_bytes come to BROADCAST_BYTES at most."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def give_back() -> None:
    """Returns a Python worker's free memory to the system: workers outlive their stage and share the executor with the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def thrifty(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f, which gives back what it held for a large group."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of undirected edges; component is the least node reachable.

    Alternating large-star and small-star steps, each a minimum per node and an equi-join, so that a node with very many
    neighbours is pre-aggregated and split like any skewed join.  They end when the graph is made of stars: when every node
    with a smaller neighbour has no other.  Nulls and loops are dropped; no edges give no rows.
    """
    now = saved(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("m < u and n > 1").isEmpty():
            break
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        # a node's least neighbour takes over its others, and the node itself
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.m").alias("u"), F.col("e.u").alias("v"))
        new = saved(small.where("u <> v").distinct(), "edges")
        forget(now)
        now = new
    pairs = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
