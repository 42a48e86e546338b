"""String similarity: kernels that Spark lacks run in Arrow batches, each distinct pair of a worker once."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs that a worker remembers.
REMEMBERED = 1 << 16


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of integers."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(REMEMBERED)
def ratio(a: str, b: str) -> float:
    """200 times the common subsequence over both lengths; 100 for two empty strings."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs(a, b) / n


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(REMEMBERED)
def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (only_x and only_y):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    p, q = len(only_x), len(only_y)
    indel = p + q - 2 * lcs(only_x, only_y)
    best = 100 * (1 - indel / (2 * (shared + gap) + p + q))
    if not shared:
        return best
    return max(best, 100 * (1 - (gap + p) / (2 * shared + gap + p)), 100 * (1 - (gap + q) / (2 * shared + gap + q)))


@lru_cache(REMEMBERED)
def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer, windows cut by its ends included."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0

    def best(short: str, long: str) -> float:
        m, n = len(short), len(long)
        cuts = {(max(0, i), min(n, i + m)) for i in range(1 - m, n)}
        return max(ratio(short, long[i:j]) for i, j in cuts)

    short, long = sorted((a, b), key=len)
    return max(best(short, long), best(long, short)) if len(a) == len(b) else best(short, long)


@lru_cache(REMEMBERED)
def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    turned = sum(x != y for x, y in zip(matched, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _pairs(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


ratio_udf, sort_udf, set_udf, partial_udf, jaro_udf = map(_pairs, (ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("sort", "set", "raw", "part", "jw")]))
def name_kernels(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All kernels of a pair of names in one pass."""
    kinds = (token_sort_ratio, token_set_ratio, ratio, partial_ratio, jaro_winkler)
    return pd.DataFrame([[f(x or "", y or "") for f in kinds] for x, y in zip(a, b, strict=True)], columns=["sort", "set", "raw", "part", "jw"])


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("sort", "set")]))
def token_kernels(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([[token_sort_ratio(x or "", y or ""), token_set_ratio(x or "", y or "")] for x, y in zip(a, b, strict=True)], columns=["sort", "set"])


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Of two arrays taken as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def charset_similarity(a: Column, b: Column) -> Column:
    """Where no kernel applies: common characters over the longer length."""
    chars = lambda x: F.filter(F.array_distinct(F.split(x, "")), lambda c: c != "")
    return F.size(F.array_intersect(chars(a), chars(b))).cast("double") / F.greatest(F.length(a), F.length(b), F.lit(1))


def register(spark: SparkSession) -> None:
    """Makes the kernels callable from SQL."""
    for name, f in (("indel_ratio", ratio_udf), ("token_sort_ratio", sort_udf), ("token_set_ratio", set_udf), ("partial_ratio", partial_udf), ("jaro_winkler", jaro_udf)):
        spark.udf.register(name, f)
