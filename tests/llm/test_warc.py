import base64
import hashlib
import os

import pytest
from linkwright.llm import warc
from linkwright.llm.common import new_path
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, record_type string"


def rows():
    out = [(i, f"http://x/{i}", f"page {i % 17} é" * (1 + i % 5), "mine") for i in range(300)]
    return out + [(1000, None, None, None), (1001, "http://y\r\nz", "", None), (None, "http://n", "null id", None), (7, "http://x/7", "page 7 é" * 3, None), (2000, "u", "long " * 200_000, None), *((3000 + i, "u", "same", None) for i in range(500))]


def expected(pages, least):
    latest = {}
    for page_id, _, html, _ in pages:
        key = (html or "").encode()
        latest.setdefault(key, []).append(page_id)
    out = []
    for page_id, _, html, _ in pages:
        key = (html or "").encode()
        ids = [x for x in latest[key] if x is not None]
        top = max(ids) if ids else None
        revisit = len(key) >= least and len(latest[key]) > 1 and top is not None and page_id != top
        out.append((page_id, len(key), base64.b32encode(hashlib.sha1(key).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame(rows(), SCHEMA)
    manifest = warc.write(pages, path, shards=5, roll_bytes=5000, least=least)
    assert manifest.count() > 5
    back = warc.read(spark, path)
    assert sorted(map(tuple, back.drop("url", "html").collect()), key=repr) == expected(rows(), least)
    html = {(p, h or "") for p, _, h, _ in rows()}
    assert all((r["page_id"], r["html"]) in html for r in back.where("record_type = 'response'").collect())
    assert back.where("page_id = 1000").first()["url"] is None
    assert sorted(((r["page_id"], r["url"]) for r in back.collect()), key=repr) == sorted(((p, u) for p, u, _, _ in rows()), key=repr)


def test_shards_are_even_in_bytes(spark):
    from linkwright.llm.shards import cut_points, sharded

    pages = spark.createDataFrame([(i, "x" * (20_000 if i < 100 else 200)) for i in range(2000)], "page_id long, html string")
    size = F.octet_length("html").cast("long")
    found = sharded(pages, "page_id", 8, cuts=cut_points(pages, "page_id", 8, size)).withColumn("part", F.spark_partition_id())
    parts = found.groupBy("part").agg(F.sum(size).alias("n"), F.countDistinct("shard").alias("shards")).collect()
    assert len(parts) == 8 and all(r["shards"] == 1 for r in parts)
    assert max(r["n"] for r in parts) <= 1.5 * sum(r["n"] for r in parts) / 8


def test_same_bytes_whatever_the_partitioning(spark):
    pages = spark.createDataFrame(rows(), SCHEMA)
    a, b = (new_path(spark, "warc") for _ in range(2))
    one, two = (sorted(map(tuple, warc.write(df, path, shards=4).collect())) for df, path in ((pages, a), (pages.repartition(7), b)))
    assert one == two
    assert not os.path.exists(a.removeprefix("file:") + "/_temporary")


def test_files_outside_the_manifest_and_damage(spark):
    path = new_path(spark, "warc")
    manifest = warc.write(spark.createDataFrame(rows(), SCHEMA), path, shards=2)
    folder = path.removeprefix("file://")
    open(f"{folder}/pages-999999-00000.warc.gz", "wb").write(b"left by a lost attempt")
    assert warc.read(spark, path).count() == len(rows())
    name = f"{folder}/{manifest.first()['file']}"
    data = open(name, "rb").read()
    open(name, "wb").write(data[: len(data) // 2])
    with pytest.raises(Exception, match=r"ends within|manifest says|digest|Error"):
        warc.read(spark, path).count()


def test_empty(spark):
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).count() == 0
