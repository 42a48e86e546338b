"""URL filter, with DataFrame functions only: rules, and logistic regression on hashed character n-grams of host and path.

A rule is a host with a path prefix.  It fits its host and all subdomains if the url's path starts with its path; the longest
rule that fits decides.  Other urls are judged by the regression: n-grams of ``^host/`` and of the path are hashed to weights
that are learned from a small labelled table.

A null url, or one without ``://``, has an empty host and path; no rule fits it and it has no n-grams, so that it is allowed.
Long urls are read whole, repeated urls are judged alike, and columns that the operator adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, lower_ascii

#: n-gram lengths, hashed features, L2 penalty.
GRAMS, FEATURES, PENALTY = (3, 4, 5), 1 << 13, 0.001

# Hosts of the labelled table, to block and to allow, and the paths that each of them comes with.
BLOCKED = (
    "cheap-pills", "cheap-meds", "pharmacy-pills", "viagra-cheap", "diet-pills", "casino-win", "win-casino", "best-casino", "poker-win", "casino-slots",
    "free-bets", "sport-bets", "bets-online", "free-bet", "betting-odds", "adult-x", "xxx-adult", "adult-video", "adult-chat", "porn-tube",
    "spam-farm", "link-farm", "spam-links", "content-farm", "spam-blog", "ads-track", "ad-tracker", "track-ads", "ads-server", "click-track",
)
ALLOWED = (
    "history", "university", "mathematics", "daily-news", "gardening", "recipes", "library", "museum", "weather", "theatre",
    "theory", "therapy", "thermal", "nation", "station", "thunder", "brother", "leather", "rather", "action",
    "another", "thread", "school", "hospital", "government", "city-council", "travel", "science", "music", "thanks",
)
PREFIXES, ENDS, PATHS = ("", "www.", "blog.", "m."), (".example.com", ".example.net", ".example.org"), ("/en/12", "/fr/345.html", "/de/6", "/es/78/", "/en/901?page=2")
#: Ordinary names that mean nothing: pairs of frequent letter groups.
GROUPS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es")
PLAIN = tuple(a + b for a in GROUPS for b in GROUPS if a != b)


def labelled_urls(times: int = 6) -> tuple[tuple[int, str], ...]:
    """(label, url), 1 to block: each host several times, with prefixes, ends and paths that say nothing about the label."""
    out = []
    for label, hosts, n in ((1, BLOCKED, times), (0, ALLOWED, times), (0, PLAIN, 2)):
        places = [(a, b, c) for c in PATHS for b in ENDS for a in PREFIXES]
        for i, host in enumerate(hosts):
            for k in range(n):
                prefix, end, path = places[(i * n + k) * 7 % len(places)]
                out.append((label, f"https://{prefix}{host}{end}{path}"))
    return tuple(out)


LABELLED = labelled_urls()

# Rules, allowed or blocked.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of a short list of rules that fits, as struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = (host == name) | host.endswith(f".{name}")
        out = F.when(fits & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """Feature numbers of the character n-grams of host and path, repeated as often as they occur; none for an empty host."""

    def of(text: Column, mark: str) -> Column:
        def parts(t: Column) -> Column:
            return F.concat(*(F.when(F.length(t) >= k, F.transform(F.sequence(F.lit(1), F.length(t) - (k - 1)), lambda i, k=k: F.pmod(F.xxhash64(F.lit(mark), F.substring(t, i, F.lit(k))), F.lit(FEATURES)).cast("int"))).otherwise(F.array().cast("array<int>")) for k in GRAMS))

        return let(text, parts)

    return F.when(host == "", F.array().cast("array<int>")).otherwise(F.concat(of(F.concat(F.lit("^"), host, F.lit("$")), "host"), of(path, "path")))


def train(spark: SparkSession, labelled: Sequence[tuple[int, str]] = LABELLED) -> tuple[list[float], float]:
    """Weights and intercept from a small labelled table."""
    rows = ", ".join(f"({label}D, '{url}')" for label, url in labelled)
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(label, url)").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    found = table.withColumn("_grams", grams(F.col("host"), F.col("path")))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(FEATURES)], inputCol="_grams", outputCol="features").setBinary(True)
    counted = counter.transform(found.select("label", F.col("_grams").cast("array<string>").alias("_grams")))
    model = LogisticRegression(regParam=PENALTY, maxIter=100, standardization=False).fit(counted)
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[int, str]] = LABELLED) -> DataFrame:
    """pages with host, path, rule, score (probability of block by the regression) and verdict."""
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    weights, intercept = train(pages.sparkSession, labelled)
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    table = F.lit(weights)
    total = F.aggregate(F.array_distinct(grams(F.col("host"), F.col("path"))), F.lit(0.0), lambda s, i: s + F.get(table, i))
    score = F.when(F.col("host") == "", 0.0).otherwise(1 / (1 + F.exp(-(total + F.lit(intercept)))))
    out = out.withColumns({"_fit": rule_of(F.col("host"), F.col("path"), rules), "score": score})
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select(*pages.columns, "host", "path", F.col("_fit.rule").alias("rule"), "score", verdict.alias("verdict"))
