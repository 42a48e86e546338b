"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

Documents are partitioned by the size of their shingle list, in powers of two.  In a partition every document has a one-permutation
MinHash sketch whose number of bins follows the partition's size, so that short items can be found inside long documents: each
bin holds the least hash that falls into it, and with ``BINS_PER_SHINGLE`` bins for each shingle at least, a shared shingle is
the least of its bin with a probability near 0.8 or above.  Items have a sketch for each partition in which a document could
contain them.  A document and an item that agree in a bin are a candidate; candidates are verified by exact containment of their
word shingles.  Items of fewer than ``SURE`` shingles could be missed and are sought by all shingles instead.

A word is a run outside ``\\x20\\x09-\\x0D``, A-Z lower-cased.  An item of fewer words than a shingle has is one shingle as a whole
and is sought among all runs of as many words.  Items and documents without words, null and empty ones among them, are neither found
nor contaminated.  Texts are taken whole.  Items of equal text are
reported each; rows that repeat a doc_id count as one document that has what any of them has.  Columns besides doc_id, item_id
and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, let, lower_ascii, saved

#: Words of a shingle; least share of an item's shingles; bins for each shingle; shingles from which the sketch is sure to find an item.
WORDS, LEAST, BINS_PER_SHINGLE, SURE = 5, 0.8, 4, 8
#: Largest partition, as a power of two; no text has more words.
LARGEST = 30


def words(text: Column) -> Column:
    cut = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.split(cut, r"[\x20\x09-\x0D]+")


def places(found: Column, k: int) -> Column:
    """0 to the last word that begins a shingle; null if there is none."""
    return F.when(F.size(found) >= k, F.sequence(F.lit(0), F.size(found) - k))


def hashes(text: Column, k: int) -> Column:
    """Hashes of the shingles of a text in order, repeats included; null if there is none."""
    return let(words(text), lambda w: F.transform(places(w, k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))))


def shingles(text: Column, k: int) -> Column:
    """The distinct shingles of a text; null if there is none."""
    return let(words(text), lambda w: F.array_distinct(F.transform(places(w, k), lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " "))))


def partition_of(size: Column) -> Column:
    return F.least(F.lit(LARGEST), F.floor(F.log2(size.cast("double")))).cast("int")


def sketch(found: Column, part: Column) -> Column:
    """The least hash of each bin, from hashes in any order; the bin is a hash's leading bits."""
    shift = F.lit(64) - (part + F.lit(BINS_PER_SHINGLE.bit_length() - 1))
    bin_of = lambda x: F.call_function("shiftrightunsigned", x, shift)
    return let(F.sort_array(found), lambda h: F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1)))))


def item_sketches(items: DataFrame, k: int, least: float) -> DataFrame:
    """(part, hash, item_id) for each partition that can hold an item's matches, items of SURE shingles or more."""
    sets = items.select("item_id", F.array_distinct(hashes(F.col("text"), k)).alias("h")).where(F.size("h") >= SURE)
    first = F.greatest(F.lit(0), partition_of(F.ceil(F.size("h") * least)))
    parts = sets.select("item_id", "h", F.explode(F.sequence(first, F.lit(LARGEST))).alias("part"))
    return parts.select("part", F.explode(sketch(F.col("h"), F.col("part"))).alias("hash"), "item_id")


def candidates(docs: DataFrame, items: DataFrame, k: int, least: float) -> DataFrame:
    """Distinct (doc_id, item_id) that may be contained; every hash array stays within its row."""
    wanted = saved(item_sketches(items, k, least), "sketches")
    rows = docs.select("doc_id", hashes(F.col("text"), k).alias("h"))
    made = let(F.col("h"), lambda h: let(partition_of(F.size(h)), lambda part: F.struct(part.alias("part"), sketch(h, part).alias("sketch"))))
    rows = rows.select("doc_id", F.explode(F.array(made)).alias("made")).select("doc_id", F.col("made.part").alias("part"), F.explode("made.sketch").alias("hash"))
    found = rows.join(hinted(wanted, 32), ["part", "hash"]).select("doc_id", "item_id")
    short = items.select("item_id", F.array_distinct(hashes(F.col("text"), k)).alias("h")).where(F.size("h").between(1, SURE - 1)).select("item_id", F.explode("h").alias("hash"))
    if not short.isEmpty():
        short = saved(short, "short")
        every = docs.select("doc_id", F.explode(hashes(F.col("text"), k)).alias("hash"))
        found = found.unionByName(every.join(hinted(short, 24), "hash").select("doc_id", "item_id"))
    return found.distinct()


def contained(docs: DataFrame, items: DataFrame, k: int = WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) where at least ``least`` of an item's distinct shingles are in a document."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    out = _verified(docs, items, saved(candidates(docs, items, k, least), "candidates"), k, least)
    sized = items.withColumn("_size", F.size(F.filter(words(F.col("text")), lambda x: x != "")))
    for size in sorted(r[0] for r in sized.where(F.col("_size").between(1, k - 1)).select("_size").distinct().collect()):  # k - 1 at most
        short = sized.where(F.col("_size") == size).drop("_size")
        wanted = saved(short.select("item_id", F.explode(hashes(F.col("text"), size)).alias("hash")), "short")
        every = docs.select("doc_id", F.explode(hashes(F.col("text"), size)).alias("hash"))
        found = saved(every.join(hinted(wanted, 24), "hash").select("doc_id", "item_id").distinct(), "candidates")
        out = out.unionByName(_verified(docs, short, found, size, least))
    return out


def _verified(docs: DataFrame, items: DataFrame, found: DataFrame, k: int, least: float) -> DataFrame:
    sets = items.select("item_id", shingles(F.col("text"), k).alias("item")).where("item is not null")
    # few documents are candidates: they meet the pairs before the items' texts do
    texts = docs.join(hinted(found.withColumnRenamed("doc_id", "_doc_id"), 32), F.col("doc_id").eqNullSafe(F.col("_doc_id"))).join(sets, "item_id")
    counted = texts.select("doc_id", "item_id", F.size("item").cast("long").alias("n_item"), F.size(F.array_intersect("item", F.coalesce(shingles(F.col("text"), k), F.array().cast("array<string>")))).cast("long").alias("n_shared"))
    out = counted.where(F.col("n_shared") >= F.lit(least) * F.col("n_item"))
    out = out.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean(docs: DataFrame, items: DataFrame, k: int = WORDS, least: float = LEAST) -> DataFrame:
    """The documents, with their own columns, that contain no item."""
    bad = contained(docs, items, k, least).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(saved(bad, "contaminated"), F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")
