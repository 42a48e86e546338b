"""Mixing sources to target weights, with DataFrame functions only.

Tokens (here words, or a given size) are added up per source; a source's target is its weight's share of all of them, at most
``most`` times what it has, the excess shared by weight among the others.  Each document is emitted floor(rate) times, plus once
more if a draw hashed from seed and doc_id falls below the rate's fraction.

Sources by code point, null last, a null being a source like any other.  A null or empty text has size 0 and is emitted like the
other documents of its source.  A source of size 0 has target and rate 0.  Rows that repeat a doc_id share one draw.  Columns
that the operator adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

#: Sources up to this many rows and bytes of names go to every executor; more are joined by shuffling, hot ones split by AQE.
BROADCAST_SOURCES, BROADCAST_BYTES = 50_000, 4 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1): 52 bits of the MD5 of seed and doc_id."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).  weights repeat over the sources in order.

    Water filling: sources by what they can take for their weight; the first k of them are full, where k is the least with the
    rest's common level at or below the next source's limit.  The one window without a key runs over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    totals = totals.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before_size, before_weight = F.coalesce(F.sum(limit).over(upto), F.lit(0.0)), F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - before_size) / (F.sum("weight").over(everything) - before_weight)
    levels = totals.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= limit / F.col("weight"), F.col("level")))
    final = F.first("fits", ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(limit, F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight"))
    out = levels.withColumn("final", final).withColumn("target", target)
    return out.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 42) -> DataFrame:
    """docs with size, source_size, target, rate and copies (int) for every document."""
    sized = docs.drop("size", "source_size", "target", "rate", "copies").withColumn("size", word_count(F.col("text")))
    targets = saved(source_targets(sized.select("source", "size"), weights, most), "targets").withColumnRenamed("source", "_source")
    bound = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_source")), F.lit(0))).first()
    if bound[0] <= BROADCAST_SOURCES and bound[1] <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    planned = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    extra = draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")
    return planned.withColumn("copies", (F.floor("rate") + extra.cast("long")).cast("int"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 42) -> DataFrame:
    """The mixed corpus: each document as often as mix_plan() says, with the columns of docs."""
    planned = mix_plan(docs, weights, most, seed).where("copies > 0")
    return planned.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
