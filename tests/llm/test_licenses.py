import textwrap

from linkwright.llm import common, licenses

from .helpers import frame


def test_whole_texts_and_lines(spark):
    mit = licenses.MIT.replace("<year> <copyright holders>", "2024 Some One").upper().replace("\n\n", "\n  \n").replace(",", " ,")
    texts = [mit, licenses.ZLIB.replace("License", "Licence"), "text.\nReleased under the mit licence!\nmore\nReleased under the MIT License.", None, "", "Copyright 2020 x\n(c) y", "plain text", "words " * 50_000 + "\nLicensed under CC BY-NC 4.0.", "plain text"]
    found = [r for r in licenses.scan(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)], ["digest", "license"])).orderBy("doc_id").collect()]
    assert [r["license"] for r in found] == ["MIT", "Zlib", None, None, None, None, None, None, None]
    assert [r["line_licenses"] for r in found][2] == ["MIT"] and found[7]["line_licenses"] == ["CC-BY-NC-4.0"] and found[6]["line_licenses"] == []
    assert [r["digest"] is None for r in found] == [False, False, False, True, True, True, False, False, False]
    assert found[6]["digest"] == found[8]["digest"]


def test_every_known_text_and_empty_tables(spark):
    docs = frame(spark, [(i, t, n, None) for i, (n, t) in enumerate(licenses.KNOWN)])
    assert all(r["license"] == r["lang"] for r in licenses.scan(docs).collect())
    assert licenses.scan(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([], "license string, text string")
    assert licenses.scan(docs, nothing).where("license is not null or size(line_licenses) > 0").count() == 0


def test_wrapped_texts(spark):
    rows = [(name, "\n\n".join(textwrap.fill(x, width) for x in text.split("\n\n"))) for name, text in licenses.KNOWN for width in (45, 60, 72, 80)]
    found = licenses.scan(frame(spark, [(i, t, n, None) for i, (n, t) in enumerate(rows)])).collect()
    assert [r["doc_id"] for r in found if r["license"] != r["lang"]] == []


def test_copyright_lines(spark):
    lines = {"Copyright (c) 2020 A": True, "  © B": True, "(C) 2019 D": True, "copyright 1999-2001 E": True, "Copyright Some Company": True, "All rights reserved.": True, "copyright notice and this permission notice": False, "COPYRIGHT HOLDERS BE LIABLE": False, "copyright": False, "the copyright": False, "copyright, and so on": False}
    df = spark.createDataFrame(list(lines.items()), "line string, is boolean")
    assert df.where(licenses.copyright_line(df["line"]) != df["is"]).collect() == []


def test_many_known_texts(spark, monkeypatch):
    many = spark.range(5000).selectExpr("concat('L', id) as license", "concat('text ', id) as text")
    for size in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", size)
        found = licenses.scan(frame(spark, [(1, "Text 77", None, None), (None, "a\ntext 4999\nTEXT, 3", None, None)]), many).collect()
        assert sorted((r["license"] or "", r["line_licenses"]) for r in found) == [("", ["L3", "L4999"]), ("L77", ["L77"])]
