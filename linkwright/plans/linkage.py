"""The linkage runs end to end: baseline, large, rerank, and the refinement of runs."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, evaluate, features, prepare, resolve, scoring, validate
from ..operators.model import PairClassifier
from ..sources import tables
from .tracking import ExperimentLog, format_dashboard, load_config


@dataclass(frozen=True)
class BaselineConfig:
    """What a configuration file may set."""

    max_candidates_per_s1: int = 50
    default_threshold: float = 0.75

    @classmethod
    def read(cls, path: str) -> BaselineConfig:
        found = load_config(path)
        return cls(found.get("blocking", {}).get("max_candidates_per_s1", 50), found.get("decision", {}).get("default_threshold", 0.75))


def baseline_scored(anchors: DataFrame, targets: DataFrame, config: BaselineConfig = BaselineConfig()) -> tuple[DataFrame, DataFrame]:
    """Candidates, and scored pairs, of processed records."""
    pairs = blocking.candidate_pairs(anchors, targets, most=config.max_candidates_per_s1)
    keep = ["id", "name", "address", "house_number", "postal_code", "city", "state", "unit"]
    rows = blocking.candidate_records(anchors, targets, keep, most=config.max_candidates_per_s1)
    return pairs, features.base_features(rows).withColumn("score", scoring.baseline_score())


def run_baseline(spark: SparkSession, s1: str, s2: str, s3: str, output: str, truth: str | None = None, config: BaselineConfig = BaselineConfig(), log: ExperimentLog | None = None, experiment_id: str = "run_baseline") -> tuple[validate.Report, dict]:
    """Files in, a validated run file out; with a truth file, the metrics too."""
    read = lambda path, n: tables.read_records(spark, path, f"source_{n}_id", f"s{n}")
    sources = [prepare.processed(read(path, n), "raw_name", "raw_address") for n, path in ((1, s1), (2, s2), (3, s3))]
    anchors, targets = sources[0], tables.union_sources(*sources[1:])
    pairs, scored = baseline_scored(anchors, targets, config)
    run = resolve.decide(scored, anchors, config.default_threshold).cache()
    expected = anchors.select(F.col("id").alias("s1_id"), "ord")
    tables.write_run(run, expected, output)
    report = validate.validate_file(spark, output, expected, targets.select("id"))
    metrics: dict = {}
    if truth:
        true = tables.read_truth(spark, truth)
        quality = blocking.blocking_quality(pairs, true, anchors).first().asDict()
        metrics = evaluate.dashboard(run, true, expected).first().asDict() | quality
        print(format_dashboard(metrics))
        if log:
            log.add(experiment_id, "End-to-end baseline run", {k: float(v) for k, v in metrics.items()}, {"threshold": config.default_threshold})
    return report, metrics


def large_scored(anchors: DataFrame, targets: DataFrame, limits: blocking.Cascade = blocking.Cascade(), most: int = 20) -> DataFrame:
    """Screened candidates of prepared records, the best of each anchor by the heuristic."""
    pairs = blocking.cascade(anchors, targets, limits).select("s1_id", "target_id")
    keep = ["id", "country", "source", "clean_name", "clean_addr", "tokens", "addr_tokens", "house", "postal"]
    rows = features.pair_records(pairs, anchors.select(keep), targets.select(keep))
    return scoring.top_candidates(scoring.screen_large(rows), most)


def rerank_scored(anchors: DataFrame, targets: DataFrame, limits: blocking.Additive = blocking.Additive(), most: int = 20) -> DataFrame:
    """The same by the reranking rules."""
    pairs = blocking.additive(anchors, targets, limits)
    keep = ["id", "source", "clean_name", "clean_addr", "tokens", "addr_tokens", "house", "postal", "shingle"]
    rows = features.pair_records(pairs, anchors.select(keep), targets.select(keep))
    return scoring.top_candidates(scoring.gate_rerank(rows), most)


def run_large(scored: DataFrame, anchors: DataFrame, classifier: PairClassifier | None = None, threshold: float = 0.45, candidates: int = 15) -> DataFrame:
    """(s1_id, matched_ids, candidate_ids) by a classifier's probability over the large features, or by the heuristic."""
    rows = features.large_features(scored)
    rows = classifier.predict(rows, "p") if classifier else rows.withColumn("p", F.col("score"))
    return resolve.ranked_lists(rows, anchors, F.col("p") >= threshold, candidates, score="p")


def run_rerank(scored: DataFrame, anchors: DataFrame, classifier: PairClassifier | None = None, candidates: int = 15, matches: int = 4) -> DataFrame:
    rows = features.large_features(scored, rerank=True)
    rows = classifier.predict(rows, "p") if classifier else rows.withColumn("p", F.col("score"))
    return resolve.ranked_lists(rows, anchors, scoring.accept_rerank(F.col("p")), candidates, matches, "p")


def rescore(run: DataFrame, anchors: DataFrame, targets: DataFrame, classifier: PairClassifier | None = None, candidates: int = 15, matches: int = 10) -> DataFrame:
    """A run's candidates scored again; candidates without a record are left out."""
    pairs = run.select("s1_id", F.explode("candidate_ids").alias("target_id")).distinct()
    rows = features.large_features(features.pair_records(pairs, anchors, targets), rerank=True)
    rows = classifier.predict(rows, "p") if classifier else rows.withColumn("p", F.col("heur"))
    return resolve.ranked_lists(rows, anchors, scoring.accept_rescored(F.col("p")), candidates, matches, "p")


def refine(base: DataFrame, rescue: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """Union of runs, then the pruning of contradicting houses and regions."""
    merged = resolve.union_runs(base, rescue).drop("origin")
    return resolve.prune_regions(resolve.prune_houses(merged, anchors, targets), anchors, targets)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Link anchors to target records.")
    for name in ("s1", "s2", "s3"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--gt")
    parser.add_argument("--config")
    parser.add_argument("--output", default="output/matching_results")
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("linkwright").getOrCreate()
    config = BaselineConfig.read(options.config) if options.config else BaselineConfig()
    report, _ = run_baseline(spark, options.s1, options.s2, options.s3, options.output, options.gt, config)
    print("\n".join(report.errors) or "valid")
    return 0 if report.valid else 1


if __name__ == "__main__":
    sys.exit(main())
