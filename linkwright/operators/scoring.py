"""Scores, candidate screens and acceptance rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from .features import domain_match


def baseline_score(name: float = 0.6, address: float = 0.4) -> Column:
    """Of base features: weighted similarity less contradictions, within 0 and 1."""
    raw = name * F.col("name_token_sort_ratio") + address * F.col("addr_token_sort_ratio") - 0.5 * F.col("house_num_conflict") - 0.3 * F.col("city_conflict")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def screen_large(rows: DataFrame) -> DataFrame:
    """Pairs of prepared records that pass the candidate screen, with name_sim, addr_sim and score."""
    rows = rows.withColumns({"_nk": kernels.token_kernels("s1_clean_name", "t_clean_name"), "_as": kernels.set_udf("s1_clean_addr", "t_clean_addr")})
    both = (F.col("s1_clean_addr") != "") & (F.col("t_clean_addr") != "")
    rows = rows.withColumns({
        "addr_sim": F.when(both, F.col("_as") / 100).otherwise(0.5), "_most": F.greatest("_nk.sort", "_nk.set"),
        "domain": domain_match(F.array_distinct("s1_tokens"), F.col("t_clean_name"), F.col("t_source"), F.col("s1_country")),
        "_house": (F.col("s1_house") != "") & (F.col("s1_house") == F.col("t_house")),
    })
    keep = (F.col("_most") >= 55) | F.col("domain") | ((F.col("addr_sim") >= 0.75) & (F.col("_most") >= 30)) | (F.col("_house") & (F.col("addr_sim") >= 0.55)) | (F.col("addr_sim") >= 0.88)
    name = (0.4 * F.col("_nk.sort") + 0.6 * F.col("_nk.set")) / 100
    rows = rows.where(keep).withColumn("name_sim", F.when(F.col("domain"), F.greatest(name, F.lit(0.78))).otherwise(name))
    return rows.withColumn("score", 0.65 * F.col("name_sim") + 0.35 * F.col("addr_sim")).drop("_nk", "_as", "_most", "_house")


def gate_rerank(rows: DataFrame) -> DataFrame:
    """Pairs that pass the reranking gate, with name_sort, addr_sim and score."""
    rows = rows.withColumns({"name_sort": kernels.sort_udf("s1_clean_name", "t_clean_name"), "_as": kernels.set_udf("s1_clean_addr", "t_clean_addr")})
    both = (F.col("s1_clean_addr") != "") & (F.col("t_clean_addr") != "")
    rows = rows.withColumn("addr_sim", F.when(both, F.col("_as") / 100).otherwise(0.5))
    house = (F.col("s1_house") != "") & (F.col("s1_house") == F.col("t_house"))
    alike = (F.col("s1_shingle") != "") & (F.col("s1_shingle") == F.col("t_shingle"))
    keep = (F.col("name_sort") >= 60) | (house & (F.col("addr_sim") >= 0.55)) | (F.col("addr_sim") >= 0.85) | (alike & (F.col("name_sort") >= 50))
    return rows.where(keep).withColumn("score", 0.65 * F.col("name_sort") / 100 + 0.35 * F.col("addr_sim")).drop("_as")


def accept_rescored(p: Column) -> Column:
    """Of large features and a probability: the rescoring rule."""
    return (p >= 0.40) | ((F.col("heur") >= 0.72) & (p >= 0.25)) | ((F.col("sort_ratio") >= 0.90) & (F.col("addr_set") >= 0.65))


def accept_rerank(p: Column) -> Column:
    """The reranking rule."""
    free = F.col("house_c") == 0
    return ((p >= 0.5) & free & (F.col("sort_ratio") >= 0.65)) | ((F.col("sort_ratio") >= 0.88) & (F.col("addr_set") >= 0.65) & free) | ((F.col("house_m") == 1) & (F.col("addr_sort") >= 0.70) & (F.col("sort_ratio") >= 0.65))


def offline_screen(rows: DataFrame, least_sort: float = 70, least: float = 0.70, threshold: float = 0.45) -> DataFrame:
    """The cheap kernel first, the others for what is left; score, and whether it is predicted."""
    rows = rows.withColumn("name_sort", kernels.sort_udf("s1_clean_name", "t_clean_name")).where(F.col("name_sort") >= least_sort)
    both = (F.col("s1_clean_addr") != "") & (F.col("t_clean_addr") != "")
    rows = rows.withColumns({"name_set": kernels.set_udf("s1_clean_name", "t_clean_name"), "_as": kernels.set_udf("s1_clean_addr", "t_clean_addr")})
    score = 0.65 * (0.4 * F.col("name_sort") + 0.6 * F.col("name_set")) / 100 + 0.35 * F.when(both, F.col("_as") / 100).otherwise(0.5)
    return rows.withColumn("score", score).where(F.col("score") >= least).withColumn("predicted", F.col("score") >= threshold).drop("_as")


def best_of_each(scored: DataFrame) -> DataFrame:
    """The best score of each pair."""
    return scored.groupBy("s1_id", "target_id").agg(F.max("score").alias("score"))


def top_candidates(scored: DataFrame, most: int, score: str = "score", order: str = "target_id") -> DataFrame:
    """The best candidates of each anchor, ties by order; most is what the ranking is for."""
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.col(score).desc(), order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)
