"""Pair features: every similarity of a pair of records as named DOUBLE columns.

Kernels of names and of addresses run in one Arrow pass each; everything else is built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.address import house_number_large, house_number_rerank, postal_code, strip
from ..functions.text import canonical_name, present, tokens, tokens_large, tokens_plain, tokens_rerank

BASE = (
    "name_exact_match name_jaro_winkler name_levenshtein name_token_sort_ratio name_token_set_ratio name_token_jaccard name_shared_tokens name_len_diff name_len_ratio name_prefix_match "
    "addr_exact_match addr_token_sort_ratio addr_token_set_ratio addr_token_jaccard house_num_match house_num_conflict postal_match postal_conflict city_match city_conflict state_match state_conflict "
    "unit_match unit_conflict missing_house_asymm missing_postal_asymm missing_city_asymm blocking_pass_count has_pass_a has_pass_b has_pass_c has_pass_d target_is_s2 target_is_s3"
).split()
LARGE = (
    "sort_ratio set_ratio raw_ratio part_ratio jw exact len_diff len_ratio tok_jaccard shared_tok domain_sub has_both_addr addr_sort addr_set addr_jaccard addr_shared "
    "house_m house_c post_m post_c s1_has_h t_has_h s1_has_p t_has_p is_s2 is_s3 heur"
).split()
TRAINING = (
    "sort_ratio set_ratio raw_ratio part_ratio jw exact len_diff len_ratio can_sort can_set can_jw tok_jaccard shared_tok diff_tok_s1 diff_tok_t has_both_addr addr_sort addr_set addr_jaccard addr_shared "
    "house_m house_c post_m post_c s1_has_h t_has_h s1_has_p t_has_p is_s2 is_s3 heur"
).split()


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def pair_records(pairs: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with both records' columns, prefixed s1_ and t_; pairs of which a record is missing are left out."""
    left = anchors.select(F.col("id").alias("s1_id"), *(F.col(c).alias(f"s1_{c}") for c in anchors.columns if c != "id"))
    right = targets.select(F.col("id").alias("target_id"), *(F.col(c).alias(f"t_{c}") for c in targets.columns if c != "id"))
    return pairs.join(left, "s1_id").join(right, "target_id")


def _agreement(a: Column, b: Column, name: str) -> dict[str, Column]:
    both = present(a) & present(b)
    return {f"{name}_match": flag(both & (a == b)), f"{name}_conflict": flag(both & (a != b))}


def base_features(rows: DataFrame) -> DataFrame:
    """The 34 features of the baseline for rows of pair_records(), with blocking_passes (may be null) and target_source."""
    low = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    rows = rows.withColumns({"_n1": low(F.col("s1_name")), "_n2": low(F.col("t_name")), "_a1": low(F.col("s1_address")), "_a2": low(F.col("t_address"))})
    # rows wait beside the kernels' worker, on disk if memory is short: what can be made later is
    rows = rows.withColumns({"_nk": kernels.name_kernels("_n1", "_n2"), "_ak": kernels.token_kernels("_a1", "_a2")})
    rows = rows.withColumns({f"_t{x}": F.array_distinct(tokens(F.col(f"_{x}"))) for x in ("n1", "n2", "a1", "a2")})
    n1, n2, a1, a2 = (F.col(c) for c in ("_n1", "_n2", "_a1", "_a2"))
    names, addresses = (n1 != "") & (n2 != ""), (a1 != "") & (a2 != "")
    jac = kernels.jaccard(F.col("_tn1"), F.col("_tn2"), 1.0)
    addr_jac = kernels.jaccard(F.col("_ta1"), F.col("_ta2"), 1.0)
    chars = kernels.charset_similarity(n1, n2)
    longest, shortest = F.greatest(F.length(n1), F.length(n2)), F.least(F.length(n1), F.length(n2))
    out = {
        "name_exact_match": flag((n1 != "") & (n1 == n2)),
        "name_jaro_winkler": F.when(names, F.col("_nk.jw")).otherwise(chars), "name_levenshtein": F.when(names, 1 - F.levenshtein(n1, n2) / F.greatest(longest, F.lit(1))).otherwise(chars),
        "name_token_sort_ratio": F.when(names, F.col("_nk.sort") / 100).otherwise(jac), "name_token_set_ratio": F.when(names, F.col("_nk.set") / 100).otherwise(jac),
        "name_token_jaccard": jac, "name_shared_tokens": F.size(F.array_intersect("_tn1", "_tn2")).cast("double"),
        "name_len_diff": F.abs(F.length(n1) - F.length(n2)).cast("double"), "name_len_ratio": F.when(longest > 0, shortest / F.greatest(longest, F.lit(1))).otherwise(1.0),
        "name_prefix_match": flag((F.length(n1) >= 4) & (F.length(n2) >= 4) & (F.substring(n1, 1, 4) == F.substring(n2, 1, 4))),
        "addr_exact_match": flag((a1 != "") & (a1 == a2)),
        "addr_token_sort_ratio": F.when(addresses, F.col("_ak.sort") / 100).otherwise(addr_jac), "addr_token_set_ratio": F.when(addresses, F.col("_ak.set") / 100).otherwise(addr_jac), "addr_token_jaccard": addr_jac,
    }
    for column, name in (("house_number", "house_num"), ("postal_code", "postal"), ("city", "city"), ("state", "state"), ("unit", "unit")):
        out |= _agreement(F.col(f"s1_{column}"), F.col(f"t_{column}"), name)
    for column, name in (("house_number", "house"), ("postal_code", "postal"), ("city", "city")):
        has = [F.coalesce(present(F.col(f"{side}_{column}")), F.lit(False)) for side in ("s1", "t")]
        out[f"missing_{name}_asymm"] = flag(has[0] != has[1])
    passes = F.array_distinct(F.coalesce("blocking_passes", F.array().cast("array<string>")))
    out["blocking_pass_count"] = F.size(passes).cast("double")
    out |= {f"has_pass_{p}": flag(F.array_contains(passes, f"pass_{p}")) for p in "abcd"}
    out |= {f"target_is_{s}": flag(F.col("target_source") == s) for s in ("s2", "s3")}
    return rows.withColumns(out).drop(*(c for c in ("_n1", "_n2", "_a1", "_a2", "_tn1", "_tn2", "_ta1", "_ta2", "_nk", "_ak")))


def _address_and_numbers(rows: DataFrame, toks, house) -> dict[str, Column]:
    a1, a2 = F.col("s1_clean_addr"), F.col("t_clean_addr")
    both = (a1 != "") & (a2 != "")
    t_tokens = F.array_distinct(toks(a2))
    out = {
        "has_both_addr": flag(both), "addr_sort": F.when(both, F.col("_ak.sort") / 100).otherwise(0.5), "addr_set": F.when(both, F.col("_ak.set") / 100).otherwise(0.5),
        "addr_jaccard": F.when(both, kernels.jaccard(F.col("s1_addr_tokens"), t_tokens, 0.0)).otherwise(0.0), "addr_shared": F.when(both, F.size(F.array_intersect("s1_addr_tokens", t_tokens)).cast("double")).otherwise(0.0),
    }
    for name, a, b in (("house", F.col("s1_house"), house(a2)), ("post", F.col("s1_postal"), postal_code(a2))):
        found = _agreement(a, b, name)
        out |= {f"{name}_m": found[f"{name}_match"], f"{name}_c": found[f"{name}_conflict"], f"s1_has_{name[0]}": flag(a != ""), f"t_has_{name[0]}": flag(b != "")}
    return out | {"is_s2": flag(F.col("t_source") == "s2"), "is_s3": flag(F.col("t_source") != "s2")}


def _names(n1: Column, n2: Column) -> dict[str, Column]:
    longest = F.greatest(F.length(n1), F.length(n2), F.lit(1))
    return {
        "sort_ratio": F.col("_nk.sort") / 100, "set_ratio": F.col("_nk.set") / 100, "raw_ratio": F.col("_nk.raw") / 100, "part_ratio": F.col("_nk.part") / 100, "jw": F.col("_nk.jw"),
        "exact": flag(n1 == n2), "len_diff": F.abs(F.length(n1) - F.length(n2)).cast("double"), "len_ratio": F.least(F.length(n1), F.length(n2)) / longest,
    }


def domain_match(rows_tokens: Column, target_name: Column, target_source: Column, country: Column | None = None) -> Column:
    """A target of the second table whose name holds an anchor's token of four letters or more, as a web domain would."""
    found = (target_source != "s2") & F.exists(rows_tokens, lambda t: (F.length(t) >= 4) & F.contains(target_name, t))
    return found & (country != "India") if country is not None else found


def large_features(rows: DataFrame, rerank: bool = False) -> DataFrame:
    """The 27 features of the large runs for rows of pair_records() of prepared records.

    rerank takes the reranking rules: names are canonical first, while the anchor's tokens stay as they are, and no domain is sought.
    """
    n1, n2 = F.col("s1_clean_name"), F.col("t_clean_name")
    if rerank:
        n1, n2 = canonical_name(n1), canonical_name(n2)
    toks, house = (tokens_rerank, house_number_rerank) if rerank else (tokens_large, house_number_large)
    rows = rows.withColumns({"_n1": n1, "_n2": n2})
    rows = rows.withColumns({"_nk": kernels.name_kernels("_n1", "_n2"), "_ak": kernels.token_kernels("s1_clean_addr", "t_clean_addr"), "_t": F.array_distinct(toks(F.col("_n2"))), "_s": F.array_distinct("s1_tokens")})
    out = _names(F.col("_n1"), F.col("_n2")) | _address_and_numbers(rows, toks, house)
    out |= {"tok_jaccard": kernels.jaccard(F.col("_s"), F.col("_t"), 0.0), "shared_tok": F.size(F.array_intersect("_s", "_t")).cast("double")}
    out["domain_sub"] = F.lit(0.0) if rerank else flag(domain_match(F.col("_s"), F.col("_n2"), F.col("t_source")))
    rows = rows.withColumns(out)
    heur = 0.65 * (0.4 * F.col("sort_ratio") + 0.6 * F.col("set_ratio")) + 0.35 * F.col("addr_set")
    return rows.withColumn("heur", heur).drop("_n1", "_n2", "_nk", "_ak", "_t", "_s")


def training_features(rows: DataFrame) -> DataFrame:
    """The 31 features of the trainer: raw and canonical names side by side."""
    rows = rows.withColumns({"_c1": canonical_name(F.col("s1_clean_name")), "_c2": canonical_name(F.col("t_clean_name"))})
    rows = rows.withColumns({"_nk": kernels.name_kernels("s1_clean_name", "t_clean_name"), "_ck": kernels.name_kernels("_c1", "_c2"), "_ak": kernels.token_kernels("s1_clean_addr", "t_clean_addr")})
    rows = rows.withColumns({"_t": F.array_distinct(tokens_rerank(F.col("_c2"))), "_s": F.array_distinct("s1_tokens")})
    out = _names(F.col("s1_clean_name"), F.col("t_clean_name")) | _address_and_numbers(rows, tokens_rerank, house_number_rerank)
    out |= {"can_sort": F.col("_ck.sort") / 100, "can_set": F.col("_ck.set") / 100, "can_jw": F.col("_ck.jw"), "tok_jaccard": kernels.jaccard(F.col("_s"), F.col("_t"), 0.0)}
    for name, size in (("shared_tok", F.array_intersect("_s", "_t")), ("diff_tok_s1", F.array_except("_s", "_t")), ("diff_tok_t", F.array_except("_t", "_s"))):
        out[name] = F.size(size).cast("double")
    rows = rows.withColumns(out)
    return rows.withColumn("heur", 0.65 * (0.4 * F.col("can_sort") + 0.6 * F.col("can_set")) + 0.35 * F.col("addr_set")).drop("_c1", "_c2", "_nk", "_ck", "_ak", "_t", "_s")


__all__ = ["BASE", "LARGE", "TRAINING", "base_features", "domain_match", "flag", "large_features", "pair_records", "tokens_plain", "training_features"]
