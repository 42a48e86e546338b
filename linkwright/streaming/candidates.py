"""Targets as a stream: blocked against static anchors, the best candidates of each anchor merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring
from ..plans.linkage import large_scored


def merge_top(old: DataFrame | None, new: DataFrame, most: int = 15) -> DataFrame:
    """The best candidates of each anchor among those so far and new ones."""
    rows = new.select("s1_id", "target_id", "score")
    rows = rows if old is None else old.select("s1_id", "target_id", "score").unionByName(rows)
    return scoring.top_candidates(scoring.best_of_each(rows), most).select("s1_id", "target_id", "score")


def stream_candidates(targets: DataFrame, anchors: DataFrame, prepare_batch, path: str, checkpoint: str, most: int = 15) -> StreamingQuery:
    """Keeps each batch's top candidates under path/batch=n, replacing a batch that is repeated after a failure.

    Every batch is cut to its own best before it is stored, so that top_so_far() merges a bounded number for an anchor.
    """
    def one(batch: DataFrame, number: int) -> None:
        found = large_scored(anchors, prepare_batch(batch), most=most)
        found.select("s1_id", "target_id", "score").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return targets.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def top_so_far(spark, path: str, most: int = 15) -> DataFrame:
    return merge_top(None, spark.read.parquet(path), most)


def event_windows(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, for late events up to a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
