import pytest
from pyspark.sql import functions as F

from linkwright.operators import blocking, evaluate, features, prepare, resolve, validate
from linkwright.plans import linkage
from linkwright.plans.tracking import ExperimentLog, format_dashboard, load_folds, package, save_folds
from linkwright.sources import tables

from .helpers import golden_files


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    files = golden_files(tmp_path_factory.mktemp("golden"))
    sources = [prepare.processed(tables.read_records(spark, files[f"s{n}"], f"source_{n}_id", f"s{n}"), "raw_name", "raw_address") for n in (1, 2, 3)]
    return files, sources[0].cache(), tables.union_sources(*sources[1:]).cache()


def test_candidates(golden):
    pairs = blocking.candidate_pairs(golden[1], golden[2], most=50).collect()
    found = {}
    for r in pairs:
        found.setdefault(r["s1_id"], {})[r["target_id"]] = r["blocking_passes"]
    assert {k[-3:]: sorted(x[:2] + x[-3:] for x in v) for k, v in found.items()} == {
        "002": ["S2002"], "003": ["S2003", "S3003"], "004": ["S2004", "S3004"], "005": ["S2005", "S3005"], "006": ["S2006"], "007": ["S2007", "S3007"], "008": ["S3008"], "010": ["S2010", "S3010"],
    }
    assert found["S1_004"]["S2_004"] == ["pass_d"] and set(found["S1_004"]["S3_004"]) >= {"pass_a", "pass_b"}


def test_end_to_end(spark, golden, tmp_path):
    files = golden[0]
    log = ExperimentLog(tmp_path / "runs.jsonl", tmp_path / "runs.md")
    report, m = linkage.run_baseline(spark, files["s1"], files["s2"], files["s3"], str(tmp_path / "out"), files["truth"], log=log)
    assert report.valid, report.errors
    assert report.stats == {"total_rows": 10, "singletons": 2, "single_match": 4, "multi_match": 4, "total_matches_predicted": 12, "max_matches": 2}
    assert m["entity_macro_f05"] == pytest.approx(0.9) and m["pair_precision"] == pytest.approx(11 / 12) and m["pair_recall"] == 1
    assert m["singleton_accuracy"] == pytest.approx(2 / 3) and m["exact_set_accuracy"] == pytest.approx(0.9) and m["false_merges_per_100_s1"] == pytest.approx(10)
    assert m["candidate_recall"] == 1 and m["avg_candidates_per_s1"] == pytest.approx(1.3) and m["median_candidates"] == 1.5 and m["p90_candidates"] == 2
    assert "91.67%" in (tmp_path / "runs.md").read_text() and len(log.entries()) == 1
    back = {r["s1_id"]: r["matched_ids"] for r in tables.read_results(spark, str(tmp_path / "out")).collect()}
    assert back["S1_004"] == ["S3_004"] and back["S1_001"] == [] and back["S1_003"] == ["S2_003", "S3_003"]
    assert "Pair Precision:            91.67%" in format_dashboard(m)


def record(spark, **values):
    base = dict.fromkeys(("name", "address", "house_number", "postal_code", "city", "state", "unit"))
    return spark.createDataFrame([base | values], "name string, address string, house_number string, postal_code string, city string, state string, unit string")


def compare(spark, a, b, passes=None, source="s2"):
    left, right = record(spark, **a).withColumn("id", F.lit("a")), record(spark, **b).withColumn("id", F.lit("b"))
    pairs = spark.createDataFrame([("a", "b", source, passes)], "s1_id string, target_id string, target_source string, blocking_passes array<string>")
    return features.base_features(features.pair_records(pairs, left, right)).first()


def test_franchise_and_address_collisions(spark):
    f = compare(spark, {"name": "star cafe", "address": "1 a st, x", "house_number": "1", "city": "x", "postal_code": "11111"}, {"name": "star cafe", "address": "2 b st, y", "house_number": "2", "city": "y", "postal_code": "22222"})
    assert (f["name_exact_match"], f["house_num_conflict"], f["city_conflict"], f["postal_conflict"]) == (1, 1, 1, 1)
    f = compare(spark, {"name": "alpha", "address": "1 a st", "house_number": "1"}, {"name": "beta", "address": "1 a st", "house_number": "1"})
    assert (f["addr_exact_match"], f["name_exact_match"], f["name_token_jaccard"], f["house_num_match"]) == (1, 0, 0, 1)
    f = compare(spark, {"name": "a", "house_number": "500"}, {"name": "a", "house_number": "502"})
    assert (f["house_num_conflict"], f["house_num_match"]) == (1, 0)


def test_missing_values_and_fallbacks(spark):
    f = compare(spark, {"name": "", "house_number": "1"}, {"name": None, "house_number": None}, ["pass_b", "pass_a", "pass_a"], "s3")
    assert (f["name_token_sort_ratio"], f["name_jaro_winkler"], f["name_len_ratio"], f["addr_token_set_ratio"]) == (1, 0, 1, 1)
    assert (f["missing_house_asymm"], f["house_num_match"], f["house_num_conflict"]) == (1, 0, 0)
    assert (f["blocking_pass_count"], f["has_pass_a"], f["has_pass_d"], f["target_is_s3"]) == (2, 1, 0, 1)
    assert all(f[c] is not None for c in features.BASE)


def test_suffixes_and_streets_agree(spark):
    rows = spark.createDataFrame([("Acme Corporation", "12 Oak Parkway, Reno NV 89501"), ("Acme Corp", "12 Oak Pkwy, Reno NV 89501")], "name string, address string")
    a, b = prepare.processed(rows).collect()
    assert (a["name"], a["address"], a["house_number"], a["postal_code"]) == (b["name"], b["address"], b["house_number"], b["postal_code"])


def test_decisions(spark):
    scored = spark.createDataFrame([("a", "t2", "s2", 0.95, 1.0), ("a", "t1", "s3", 0.75, 0.0), ("a", "t3", "s2", 0.7499, 0.0), ("b", "t9", "s2", 0.8, 0.0)], "s1_id string, target_id string, target_source string, score double, house_num_conflict double")
    anchors = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    get = lambda df: {r["s1_id"]: r["matched_ids"] for r in df.collect()}
    assert get(resolve.decide(scored, anchors)) == {"a": ["t1"], "b": ["t9"], "c": []}
    assert get(resolve.decide(scored, anchors, contradictions=False))["a"] == ["t1", "t2"]
    assert get(resolve.decide(scored, anchors, by_source={"s2": 0.9}))["b"] == []


def test_entity_metrics(spark):
    cases = [([], [], (1, 1, 1, 0, 0)), ([], ["x"], (0, 1, 0, 1, 0)), (["x"], [], (0, 0, 0, 0, 1)), (["a", "b"], ["a", "c"], (0.5, 0.5, 0.5, 1, 1))]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, t array<string>, p array<string>")
    for r in df.select("i", evaluate.entity_metrics(F.col("t"), F.col("p")).alias("m")).collect():
        assert tuple(r["m"][c] for c in ("precision", "recall", "f", "fp", "fn")) == pytest.approx(cases[r["i"]][2])
    run = spark.createDataFrame([("a", []), ("b", ["x"]), ("c", ["y"])], "s1_id string, matched_ids array<string>")
    truth = spark.createDataFrame([("a", []), ("b", ["x"]), ("c", ["y", "z"])], "s1_id string, matched_ids array<string>")
    m = evaluate.dashboard(run, truth).first()
    assert m["entity_macro_f05"] == pytest.approx((2 + 0.625 / 0.75) / 3) and m["exact_set_accuracy"] == pytest.approx(2 / 3) and m["missed_matches_per_100_s1"] == pytest.approx(100 / 3)
    with pytest.raises(ValueError, match="No entities"):
        evaluate.dashboard(run, truth.limit(0))


def test_sweep_has_25_thresholds_and_prefers_the_lowest(spark):
    assert len(evaluate.thresholds()) == 25 and evaluate.thresholds()[-1] == 0.98
    scored = spark.createDataFrame([("a", "x", 0.9, 0.0)], "s1_id string, target_id string, score double, house_num_conflict double")
    truth = spark.createDataFrame([("a", ["x"])], "s1_id string, matched_ids array<string>")
    best = evaluate.best_threshold(evaluate.threshold_sweep(scored, truth, truth)).first()
    assert best["threshold"] == 0.5 and best["entity_macro_f05"] == 1


def test_run_files(spark, tmp_path):
    expected = spark.createDataFrame([("a", 1), ("b", 0)], "s1_id string, ord int")
    run = spark.createDataFrame([("a", ["S3_99", "S2_10", "S3_99", " S2_05 ", "a", ""]), ("b", None)], "s1_id string, matched_ids array<string>")
    tables.write_run(run, expected, str(tmp_path / "run"))
    lines = [x for f in (tmp_path / "run").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == ["source1_entity_id\tmatched_entity_ids", "b\t", "a\tS2_05,S2_10,S3_99"]
    with pytest.raises(ValueError, match="Missing predictions for 1"):
        tables.submission_rows(run.where("s1_id = 'a'"), expected)
    with pytest.raises(ValueError, match="Extraneous 1"):
        tables.submission_rows(run, expected.where("s1_id = 'a'"))


def test_validator(spark, tmp_path):
    bad = tmp_path / "bad.tsv"
    bad.write_text("id\tids\na\tx,x\na\ty\nb\tb\n\nshort\n\tz\nc\tq\n", encoding="utf-8")
    expected = spark.createDataFrame([("a",), ("b",), ("d",)], "s1_id string")
    valid = spark.createDataFrame([("x",), ("y",), ("b",)], "id string")
    report = validate.validate_file(spark, str(bad), expected, valid)
    assert not report.valid
    rules = sorted(e.split(": ")[-1].split(" ")[0] for e in report.errors if not e.startswith("Unexpected header"))
    assert rules == ["duplicate_id", "duplicate_match", "empty_id", "invalid_target", "missing_id", "self_match", "short_row", "unexpected_id"]
    assert [e for e in report.errors if "duplicate_id" in e] == ["Line 3: duplicate_id a"]
    assert report.stats["total_rows"] == 3 and report.stats["max_matches"] == 2
    assert validate.validate_file(spark, str(tmp_path / "none")).errors[0].startswith("File not found")


def test_refinement(spark):
    schema = "s1_id string, matched_ids array<string>, candidate_ids array<string>"
    base = spark.createDataFrame([("a", ["t1", "t2", "t9"], ["t2", "t5"]), ("b", [], ["t3"]), ("c", [], [])], schema)
    rescue = spark.createDataFrame([("b", ["t4"], ["t4", "t3"]), ("z", ["t1"], ["t1"])], schema)
    merged = {r["s1_id"]: r for r in resolve.union_runs(base, rescue).collect()}
    assert set(merged) == {"a", "b", "c"} and merged["b"]["matched_ids"] == ["t4"] and merged["b"]["candidate_ids"] == ["t4", "t3"] and merged["a"]["candidate_ids"] == ["t1", "t2", "t9", "t5"]
    anchors = spark.createDataFrame([("a", "Shop", "plot 12 Main, Chicago", "US"), ("b", "x", "", "US"), ("c", "y", "", "US")], "id string, name string, address string, country string")
    targets = spark.createDataFrame([("t1", "Shop", "plot 13 Main, x", "US"), ("t2", "Shop", "plot 12/3 Main, texas", "US"), ("t4", "q", "5 ny", "US")], "id string, name string, address string, country string")
    pruned = {r["s1_id"]: r["matched_ids"] for r in resolve.prune_houses(resolve.union_runs(base, rescue), anchors, targets).collect()}
    assert pruned == {"a": ["t2", "t9"], "b": ["t4"], "c": []}
    far = targets.withColumn("name", F.lit("Other"))
    assert {r["s1_id"]: r["matched_ids"] for r in resolve.prune_regions(base, anchors, far).collect()}["a"] == ["t9"]  # "Main" holds a code, too
    assert {r["s1_id"]: r["matched_ids"] for r in resolve.prune_regions(base, anchors, targets).collect()}["a"] == ["t1", "t2", "t9"]


def test_samples_and_folds(spark, tmp_path):
    ids = spark.range(200).selectExpr("concat('e', id) as s1_id", "if(id % 3 = 0, 'US', 'IN') as country")
    truth = ids.selectExpr("s1_id", "if(length(s1_id) = 3, array('x'), array()) as matched_ids")
    sample = evaluate.stratified_sample(ids, truth, 50).collect()
    assert len(sample) == len({r["s1_id"] for r in sample}) == 50 and {r["stratum"] for r in sample} == {r["stratum"] for r in evaluate.folds(ids, truth).collect()}
    assert evaluate.stratified_sample(ids, truth, 500).count() == 200
    folds = evaluate.folds(ids, truth)
    sizes = [r["count"] for r in folds.groupBy("stratum", "fold").count().collect()]
    assert folds.select("s1_id").distinct().count() == 200 and max(sizes) - min(r["count"] for r in folds.groupBy("fold").count().collect()) <= 40
    save_folds(folds, tmp_path / "folds.json")
    assert all(not set(a) & set(b) and len(a) + len(b) == 200 for a, b in load_folds(tmp_path / "folds.json"))
    package(tmp_path / "x.zip", [tmp_path / "folds.json", tmp_path / "missing"], tmp_path)
    assert (tmp_path / "x.zip").exists()
