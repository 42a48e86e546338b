"""Validation of run files: every rule is a filter over numbered lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import strip
from ..sources.tables import CANDIDATE_COLUMN, ID_COLUMN, MATCH_COLUMN
from .evaluate import cardinalities

HEADERS = ([ID_COLUMN, MATCH_COLUMN], [ID_COLUMN, CANDIDATE_COLUMN])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text), from 1; partitions are numbered by their counts, so that no line moves."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("text"))
    part = F.shiftright("at", 33)
    counts = lines.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row for each split of the file
    starts, total = {}, 0
    for r in counts:
        starts[r["part"]] = total
        total += r["count"]
    first = F.lit(0).cast("long")
    for p, n in starts.items():
        first = F.when(part == p, F.lit(n)).otherwise(first)
    return lines.select((first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line"), "text")


def parsed_lines(lines: DataFrame, delimiter: str = "\t", separator: str = ",") -> DataFrame:
    """(line, columns, s1_id, ids) of rows below the header; empty lines are skipped."""
    cells = F.split("text", f"\\Q{delimiter}\\E", -1)
    ids = F.filter(F.transform(F.split(F.coalesce(F.get(cells, F.lit(1)), F.lit("")), f"\\Q{separator}\\E"), strip), lambda x: x != "")
    return lines.where("line > 1 and text <> ''").select("line", F.size(cells).alias("columns"), strip(F.get(cells, F.lit(0))).alias("s1_id"), ids.alias("ids"))


def violations(rows: DataFrame, expected: DataFrame | None = None, valid_targets: DataFrame | None = None) -> DataFrame:
    """(line, rule, detail); line is null for rules about the whole file.  No valid targets at all switch their rule off."""
    short = rows.where("columns < 2").select("line", F.lit("short_row").alias("rule"), "s1_id")
    full = rows.where("columns >= 2")
    empty = full.where("s1_id = ''").select("line", F.lit("empty_id").alias("rule"), "s1_id")
    named = full.where("s1_id <> ''")
    firsts = named.groupBy("s1_id").agg(F.min("line").alias("first"))
    twice = named.join(firsts, "s1_id").where("line > first").select("line", F.lit("duplicate_id").alias("rule"), "s1_id")
    repeats = named.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("line", F.lit("duplicate_match").alias("rule"), "s1_id")
    own = named.where(F.array_contains("ids", F.col("s1_id"))).select("line", F.lit("self_match").alias("rule"), "s1_id")
    out = short.unionByName(empty).unionByName(twice).unionByName(repeats).unionByName(own)
    if valid_targets is not None and not valid_targets.isEmpty():
        wrong = named.select("line", "s1_id", F.explode(F.array_distinct("ids")).alias("id")).join(valid_targets.select("id"), "id", "left_anti")
        out = out.unionByName(wrong.groupBy("line", "s1_id").count().select("line", F.lit("invalid_target").alias("rule"), "s1_id"))
    if expected is not None:
        seen = named.select("s1_id").distinct()
        none = F.lit(None).cast("long").alias("line")
        out = out.unionByName(expected.select("s1_id").distinct().join(seen, "s1_id", "left_anti").select(none, F.lit("missing_id").alias("rule"), "s1_id"))
        out = out.unionByName(seen.join(expected, "s1_id", "left_anti").select(none, F.lit("unexpected_id").alias("rule"), "s1_id"))
    return out.withColumnRenamed("s1_id", "detail")


@dataclass
class Report:
    valid: bool
    errors: list[str]
    stats: dict[str, int]


def validate_file(spark: SparkSession, path: str, expected: DataFrame | None = None, valid_targets: DataFrame | None = None, listed: int = 1000) -> Report:
    """The verdict on a file, its errors by rule and line (the first so many are spelt out), and its statistics."""
    stats = dict.fromkeys(("total_rows", "singletons", "single_match", "multi_match", "total_matches_predicted", "max_matches"), 0)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return Report(False, [f"File not found: {path}"], stats)
    lines = numbered_lines(spark, path)
    head = lines.where("line = 1").first()
    if head is None:
        return Report(False, ["File is empty."], stats)
    errors, header = [], head["text"].split("\t")
    if len(header) < 2:
        errors.append(f"Expected at least 2 columns in header, got: {header}")
    if [c.strip().lower() for c in header] not in HEADERS:
        errors.append(f"Unexpected header {header}")
    rows = parsed_lines(lines)
    found = violations(rows, expected, valid_targets)
    errors += [f"Line {r['line']}: {r['rule']} {r['detail']}" if r["line"] else f"{r['rule']} {r['detail']}" for r in found.orderBy("line", "rule", "detail").limit(listed).collect()]
    named = rows.where("columns >= 2 and s1_id <> ''")
    c = cardinalities(named.select(F.col("ids").alias("matched_ids"))).first()
    stats |= {"total_rows": named.select("s1_id").distinct().count(), "singletons": c["singleton"] or 0, "single_match": c["single_match"] or 0, "multi_match": c["multi_match"] or 0, "total_matches_predicted": c["total_matches"] or 0, "max_matches": c["max_matches"] or 0}
    return Report(not errors, errors, stats)
