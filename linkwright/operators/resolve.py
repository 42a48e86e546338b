"""From scored pairs to match sets, and the refinement and merging of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.address import house_number_rerank, region
from ..functions.text import present



def _none() -> Column:
    return F.array().cast("array<string>")


def accepted(scored: DataFrame, threshold: float = 0.75, by_source: dict[str, float] | None = None, contradictions: bool = True) -> DataFrame:
    """Pairs at or above their threshold; those whose house numbers contradict each other go if contradictions is set."""
    cutoff = F.lit(threshold)
    for source, value in (by_source or {}).items():
        cutoff = F.when(F.col("target_source") == source, F.lit(value)).otherwise(cutoff)
    out = scored.where(F.col("score") >= cutoff)
    if contradictions and "house_num_conflict" in scored.columns:
        out = out.where(F.coalesce("house_num_conflict", F.lit(0.0)) != 1)
    return out


def match_sets(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(s1_id, matched_ids) for every anchor, sorted, empty for none."""
    sets = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_set("target_id")).alias("matched_ids"))
    return anchors.select(F.col("id").alias("s1_id")).join(sets, "s1_id", "left").withColumn("matched_ids", F.coalesce("matched_ids", _none()))


def decide(scored: DataFrame, anchors: DataFrame, threshold: float = 0.75, by_source: dict[str, float] | None = None, contradictions: bool = True) -> DataFrame:
    return match_sets(accepted(scored, threshold, by_source, contradictions), anchors)


def ranked_lists(scored: DataFrame, anchors: DataFrame, accept: Column, candidates: int = 15, matches: int | None = None, score: str = "score") -> DataFrame:
    """(s1_id, matched_ids, candidate_ids): the best candidates in order of score, and those of them that are accepted, at most so many."""
    item = F.struct((-F.col(score)).alias("by"), "target_id", accept.alias("ok"))
    lists = scored.groupBy("s1_id").agg(F.slice(F.array_sort(F.collect_list(item)), 1, candidates).alias("_c"))
    out = anchors.select(F.col("id").alias("s1_id")).join(lists, "s1_id", "left").withColumn("_c", F.coalesce("_c", F.array().cast(lists.schema["_c"].dataType)))
    ok = F.transform(F.filter("_c", lambda x: x["ok"]), lambda x: x["target_id"])
    return out.select("s1_id", (F.slice(ok, 1, matches) if matches else ok).alias("matched_ids"), F.transform("_c", lambda x: x["target_id"]).alias("candidate_ids"))


def ordered_union(*lists: Column, most: int = 15) -> Column:
    """Each id once, where it comes first; the first so many."""
    return F.slice(F.array_distinct(F.concat(*lists)), 1, most)


def union_runs(base: DataFrame, rescue: DataFrame) -> DataFrame:
    """Base matches, or the rescue's where base has none; ids that only the rescue has are left out."""
    other = rescue.select("s1_id", F.col("matched_ids").alias("_m"), F.col("candidate_ids").alias("_c"))
    rows = base.join(other, "s1_id", "left").withColumns({c: F.coalesce(c, _none()) for c in ("_m", "_c")})
    kept, rescued = F.size("matched_ids") > 0, F.size("_m") > 0
    m, c = F.col("matched_ids"), F.col("candidate_ids")
    candidates = F.when(kept, ordered_union(m, c)).when(rescued, ordered_union(F.col("_m"), F.col("_c"), c)).otherwise(ordered_union(c, F.col("_c")))
    how = F.when(kept, "base").when(rescued, "rescued").otherwise("none")
    return rows.select("s1_id", F.when(kept, m).when(rescued, F.col("_m")).otherwise(_none()).alias("matched_ids"), candidates.alias("candidate_ids"), how.alias("origin"))


def within_candidates(matched: Column, candidates: Column) -> Column:
    return F.filter(matched, lambda x: F.array_contains(candidates, x))


def _regroup(run: DataFrame, kept: DataFrame) -> DataFrame:
    """The run with the kept matches (s1_id, pos, target_id), candidates completed by them."""
    sets = kept.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target_id"))), lambda x: x["target_id"]).alias("_m"))
    rows = run.join(sets, "s1_id", "left")
    m = F.coalesce("_m", _none())
    # where nothing was matched before, candidates are cut as they stand
    candidates = F.when(F.size("matched_ids") > 0, ordered_union(m, F.col("candidate_ids"))).otherwise(F.slice("candidate_ids", 1, 15))
    return rows.select("s1_id", m.alias("matched_ids"), candidates.alias("candidate_ids"))


def _matches(run: DataFrame) -> DataFrame:
    return run.select("s1_id", F.posexplode("matched_ids").alias("pos", "target_id"))


def prune_houses(run: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """Matches go whose raw addresses have different house numbers, none within the other."""
    left = anchors.select(F.col("id").alias("s1_id"), house_number_rerank(F.col("address")).alias("_a"))
    right = targets.select(F.col("id").alias("target_id"), house_number_rerank(F.col("address")).alias("_b"))
    rows = _matches(run).join(left, "s1_id", "left").join(right, "target_id", "left")
    a, b = F.col("_a"), F.col("_b")
    against = present(a) & present(b) & (a != b) & ~F.contains(a, b) & ~F.contains(b, a)
    return _regroup(run, rows.where(~F.coalesce(against, F.lit(False))).select("s1_id", "pos", "target_id"))


def prune_regions(run: DataFrame, anchors: DataFrame, targets: DataFrame, alike: float = 92) -> DataFrame:
    """Matches go whose regions are known and differ, unless the names are alike; targets without a record stay."""
    side = lambda df, key, p: df.select(F.col("id").alias(key), F.lower("name").alias(f"_n{p}"), region(F.col("address"), F.col("country")).alias(f"_r{p}"))
    rows = _matches(run).join(side(anchors, "s1_id", 1), "s1_id", "left").join(side(targets, "target_id", 2), "target_id", "left")
    differ = F.coalesce(present(F.col("_r1")) & present(F.col("_r2")) & (F.col("_r1") != F.col("_r2")), F.lit(False))
    near = F.when(differ, kernels.sort_udf("_n1", "_n2") >= alike)
    return _regroup(run, rows.where(~differ | near).select("s1_id", "pos", "target_id"))
