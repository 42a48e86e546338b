"""Deterministic range shards of rows, and files written by tasks under temporary names."""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows per shard that the cut points are drawn from, which only even out the shards; bytes of a shard beyond which there are more.
DRAWN, SHARD_BYTES = 64, 256 << 20


def shard_count(df: DataFrame, size: Column) -> int:
    """Shards for rows of these sizes: a task for each shuffle partition, and more where they would pass SHARD_BYTES."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n")).first()["n"]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))


def cut_points(df: DataFrame, key: str, shards: int, size: Column | None = None) -> list[int]:
    """Sorted values of an integer key that split the rows into shards of about equal size, by rows if none is given; the same in every run."""
    own = df.select(F.col(key).cast("long").alias("key"), (F.lit(1) if size is None else size + 1).cast("double").alias("size"))
    total = own.agg(F.coalesce(F.sum("size"), F.lit(0.0))).first()[0]
    if shards < 2 or total < 2:
        return []
    # a row is drawn the likelier the larger it is, and stands for as much as it makes likely
    share = total / (shards * DRAWN)
    chosen = own.where(F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.col("size") / share * (1 << 40)))
    sizes = chosen.groupBy("key").agg(F.sum(F.greatest("size", F.lit(share))).cast("long").alias("size"))
    drawn = np.fromiter(((r["key"], r["size"]) for r in sizes.toLocalIterator()), np.dtype([("key", np.int64), ("size", np.int64)]))
    drawn.sort(order="key")
    before = np.cumsum(drawn["size"]) - drawn["size"]
    first = np.searchsorted(before, drawn["size"].sum() * np.arange(1, shards) / shards)
    return np.unique(drawn["key"][first[first < len(drawn)]]).tolist()


def shard_of(key: Column, cuts: list[int]) -> Column:
    """How many cut points are at or below the key, by halving; 0 for null."""
    if not cuts:
        return F.lit(0)
    table = F.array(*(F.lit(c) for c in cuts)) if len(cuts) < 100 else F.lit(cuts)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    found = F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(table, at + s - 1), F.lit((1 << 63) - 1)) <= key, at + s).otherwise(at))
    return F.when(key.isNull(), F.lit(0)).otherwise(found)


def sharded(df: DataFrame, key: str, shards: int, *ties: Column | str, cuts: list[int] | None = None) -> DataFrame:
    """df with a column shard, each shard in a partition of its own and sorted by key and ties, nulls first."""
    out = df.withColumn("shard", shard_of(F.col(key), cut_points(df, key, shards) if cuts is None else cuts))
    return out.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col(key).asc_nulls_first(), *ties)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """A file system that workers can write to, and the path in it."""
    return fs.FileSystem.from_uri(path)


class NewFile:
    """Written under a temporary name in the target folder, moved to its own by commit(); a lost attempt leaves only that."""

    def __init__(self, root: str, name: str):
        self.store, base = open_store(root)
        self.final, self.temporary = f"{base}/{name}", f"{base}/_temporary/{name}.{uuid.uuid4().hex}"
        self.store.create_dir(f"{base}/_temporary", recursive=True)
        self.out = self.store.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def commit(self) -> None:
        self.out.close()
        try:
            self.store.move(self.temporary, self.final)
        except OSError:
            # some stores don't move onto an earlier attempt's file, which holds the same bytes
            if self.store.get_file_info(self.final).type == fs.FileType.NotFound:
                raise
            self.store.delete_file(self.temporary)


def commit_manifest(rows: DataFrame, root: str) -> DataFrame:
    """Writes the rows, one per file, under a temporary name and moves them to manifest.json; returns them as read back.

    Readers take only files that the manifest names, so that a folder without one holds nothing.
    """
    spark = rows.sparkSession
    temporary, final = f"{root}/_temporary-{uuid.uuid4().hex}", f"{root}/manifest.json"
    rows.write.json(temporary)
    path = spark._jvm.org.apache.hadoop.fs.Path
    hadoop = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not hadoop.rename(path(temporary), path(final)):
        raise OSError(f"{final} can't be committed")
    hadoop.delete(path(f"{root}/_temporary"), True)
    return spark.read.schema(rows.schema).json(final)
