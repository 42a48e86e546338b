import datetime

import pytest

import __spark_entry__
from linkwright.operators import blocking, evaluate, features, model, prepare, resolve, scoring
from linkwright.plans import linkage
from linkwright.sources import tables
from linkwright.sources.adapters import part_records, split_sources
from linkwright.streaming import candidates

SF = "/root/testdata/sf0.001"


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 70


def test_result_does_not_depend_on_partitions(spark):
    def run():
        anchors, targets = split_sources(prepare.prepared_large(part_records(spark, SF), transliterate=False))
        return sorted(map(tuple, blocking.cascade(anchors, targets, blocking.Cascade(3, 2, 2, 20, 10, 2)).collect()))

    few = run()
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert run() == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_domain_names_and_screen(spark):
    schema = "id string, source string, country string, name string, address string, ord int"
    anchors = prepare.prepared_large(spark.createDataFrame([("a", "s1", "France", "Siia Investments", "1 rue x", 0)], schema))
    targets = prepare.prepared_large(spark.createDataFrame([("t", "s3", "France", "siiainvestments.com", "9 q", 0), ("u", "s2", "France", "siiainvestments.com", "9 q", 1)], schema))
    pairs = spark.createDataFrame([("a", "t"), ("a", "u")], "s1_id string, target_id string")
    found = {r["target_id"]: r for r in scoring.screen_large(features.pair_records(pairs, anchors, targets)).collect()}
    assert found["t"]["domain"] and found["t"]["name_sim"] >= 0.78 and not found.get("u", {"domain": False})["domain"]


def test_india_is_transliterated(spark):
    schema = "id string, source string, country string, name string, address string, ord int"
    rows = spark.createDataFrame([("a", "s1", "India", "राम होटल", "Plot 5", 0), ("b", "s1", "US", "राम", None, 1)], schema)
    got = {r["id"]: r for r in prepare.prepared_large(rows).collect()}
    assert got["a"]["clean_name"] == "ram hotel" and got["a"]["tokens"] == ["ram", "hotel"] and got["a"]["house"] == "5" and got["b"]["clean_name"] == ""


def test_acceptance_rules(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.0, 0.7, 0.0, 0.0, 0.0), (0.5, 1.0, 0.0, 0.7, 0.0, 0.0, 0.0), (0.1, 0.0, 0.0, 0.9, 0.7, 0.0, 0.0), (0.1, 1.0, 1.0, 0.7, 0.0, 0.7, 0.0), (0.3, 0.0, 0.0, 0.1, 0.0, 0.0, 0.8)], "p double, house_c double, house_m double, sort_ratio double, addr_set double, addr_sort double, heur double")
    from pyspark.sql import functions as F

    got = df.select(scoring.accept_rerank(F.col("p")).alias("x"), scoring.accept_rescored(F.col("p")).alias("y")).collect()
    assert [r["x"] for r in got] == [True, False, True, True, False] and [r["y"] for r in got] == [True, True, True, False, True]


def test_models(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(id % 2 as double) as label", "cast(id % 2 as double) * 0.6 + rand(1) * 0.4 as x", "rand(2) as y").cache()
    fitted = model.PairClassifier(["x", "y"], trees=3, depth=2).fit(rows)
    p = fitted.predict(rows).groupBy("label").avg("p").orderBy("label").collect()
    assert p[0][1] < 0.3 < 0.7 < p[1][1]
    fitted.save(str(tmp_path / "m"))
    assert model.PairClassifier(["x", "y"]).load(str(tmp_path / "m")).predict(rows).count() == 400
    with pytest.raises(ValueError, match="not fitted"):
        model.PairClassifier(["x"]).predict(rows)
    with pytest.raises(ValueError, match="Unknown"):
        model.ScoreCalibrator("other")
    assert model.ScoreCalibrator().transform(rows, "x").where("calibrated <> x").count() == 0
    for method in ("isotonic", "sigmoid"):
        got = model.ScoreCalibrator(method).fit(rows, "x").transform(rows, "x").collect()
        assert all(0 <= r["calibrated"] <= 1 for r in got)
        ordered = sorted(got, key=lambda r: r["x"])
        assert all(a["calibrated"] <= b["calibrated"] + 1e-9 for a, b in zip(ordered, ordered[1:], strict=False))


def test_refined_run(spark):
    anchors, targets = split_sources(prepare.prepared_large(part_records(spark, SF), transliterate=False))
    run = linkage.run_large(linkage.large_scored(anchors, targets, blocking.Cascade(3, 2, 2, 20, 10, 4)), anchors, threshold=0.6).cache()
    refined = linkage.refine(run, run, anchors, targets).collect()
    assert len(refined) == anchors.count() and all(set(r["matched_ids"]) <= set(r["candidate_ids"]) or len(r["candidate_ids"]) == 15 for r in refined)
    assert evaluate.coverage(run).first()["coverage_pct"] + evaluate.coverage(run).first()["singleton_pct"] == pytest.approx(100)
    assert resolve.match_sets(run.selectExpr("s1_id", "explode(matched_ids) as target_id"), anchors).count() == anchors.count()


def test_scans(spark, tmp_path):
    (tmp_path / "e.tsv").write_text('id\tname\taddress\tcountry\n1\t"A\tx\tUS\n2\tB\t\tIndia\n2\tC\ty\tIndia\n', encoding="utf-8")
    rows = tables.read_entities(spark, str(tmp_path / "e.tsv")).collect()
    assert [(r["id"], r["name"], r["address"]) for r in rows] == [("1", '"A', "x"), ("2", "B", ""), ("2", "C", "y")]
    india = tables.read_entities(spark, str(tmp_path / "e.tsv"), "India")
    assert [r["name"] for r in tables.last_of_each(india).collect()] == ["C"]
    assert tables.with_needed(india, spark.createDataFrame([("1",)], "id string")).count() == 0
    (tmp_path / "r.tsv").write_text("a\tz,b\nb\t\n", encoding="utf-8")
    assert [r["ids"] for r in tables.read_run(spark, str(tmp_path / "r.tsv"), header=False).collect()] == [["z", "b"], []]
    stage = tables.write_stage(india, str(tmp_path / "stage"), 2)
    assert stage.count() == 2 and tables.write_stage(india.limit(0), str(tmp_path / "stage"), 2).count() == 2


def test_streams(spark, tmp_path):
    records = part_records(spark, SF)
    anchors, targets = split_sources(records)
    anchors = prepare.prepared_large(anchors, transliterate=False)
    ready = lambda df: prepare.prepared_large(df, transliterate=False)
    whole = linkage.large_scored(anchors, ready(targets), most=5)
    for i, part in enumerate(targets.randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(targets.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    candidates.stream_candidates(stream, anchors, ready, str(tmp_path / "top"), str(tmp_path / "cp"), 5).awaitTermination()
    got = {(r["s1_id"], r["target_id"]) for r in candidates.top_so_far(spark, str(tmp_path / "top"), 5).collect()}
    assert got == {(r["s1_id"], r["target_id"]) for r in whole.collect()}
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "events"))
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(str(tmp_path / "events"))
    q = candidates.event_windows(events).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert isinstance(spark.sql("SELECT min(start) FROM windows").first()[0], datetime.datetime)


def test_production_limits_are_registered(spark):
    queries, sf = __spark_entry__.queries(), "/root/testdata/sf0.01"
    few, all_ = (queries[name](spark, sf).select("s1_id", "target_id").distinct() for name in ("block_cascade", "block_cascade_full"))
    assert few.subtract(all_).isEmpty() and all_.count() > few.count()
    for name in ("block_additive", "block_union", "block_capped", "run_large", "run_rerank", "rescore_run", "prune_house", "prune_region", "hard_negatives", "offline_screen", "screen_large", "gate_rerank", "pair_features_rerank"):
        assert queries[f"{name}_full"](spark, SF).columns == queries[name](spark, SF).columns


def test_text_queries_take_whole_texts(spark):
    queries, texts = __spark_entry__.queries(), {f"D{r['doc_id']}": r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries["clean_whitespace_text"](spark, SF).collect():
        assert (r["value"] or "").split() == (texts[r["id"]] or "").split()
    for name in ("normalize_name", "ascii_fold", "informative_tokens", "clean_tokens_large", "clean_tokens_plain", "clean_tokens_rerank"):
        size = [queries[x](spark, SF).selectExpr("sum(length(value))").first()[0] for x in (name, f"{name}_text")]
        assert size[1] > 20 * size[0]
    for name in ("longest_token", "name_shingle"):
        assert queries[f"{name}_text"](spark, SF).count() == len(texts)


def test_kernels_take_pairs_of_blocking(spark):
    queries, sf = __spark_entry__.queries(), "/root/testdata/sf0.01"
    few, all_ = (queries[name](spark, sf).count() for name in ("sim_token_jaccard", "sim_token_jaccard_full"))
    print("pairs", few, all_)
    assert all_ > few
    for name in ("levenshtein", "jaro_winkler", "ratio", "token_sort", "token_set", "partial", "charset"):
        assert queries[f"sim_{name}_full"](spark, sf).columns == ["id1", "id2", "value"]


def test_hard_negatives_of_all_anchors(spark, monkeypatch):
    def rows(source, n):
        return spark.range(n).selectExpr(f"concat('{source}', id) as id", "'US' as country", "id as ord", "array('x') as tokens", "'' as house")

    truth = spark.createDataFrame([("a0", ["t0"])], "s1_id string, matched_ids array<string>")
    found = model.hard_negatives(rows("a", 10), rows("t", 5), truth, total=None).collect()
    assert len(found) == 40 and {r["target_id"] for r in found if r["s1_id"] == "a0"} == {"t1", "t2", "t3", "t4"}
    assert model.hard_negatives(rows("a", 10), rows("t", 5), truth, total=7).count() == 7
    # the queries have no total, which their SQL doesn't have either
    asked = []
    monkeypatch.setattr(model, "hard_negatives", lambda *a, total=0, **k: asked.append(total))
    for name in ("hard_negatives", "hard_negatives_full"):
        __spark_entry__.queries()[name](spark, SF)
    assert asked == [None, None]
