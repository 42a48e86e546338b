import zlib

from linkwright.llm import langid

from .helpers import DE, EN, FR, SF, frame


def rows():
    out = []
    for i in range(60):
        for j, (lang, text) in enumerate((("en", EN), ("fr", FR), ("de", DE))):
            w = text.split()
            out.append((3 * i + j, " ".join(w[(i * k) % len(w)] for k in range(1, 30)), lang, "s"))
    return out


def test_predictions_and_held_out(spark):
    docs = frame(spark, rows() + [(900, None, "en", None), (901, "", None, "s"), (902, "12 34 !?", None, "s"), (903, (FR + " ") * 3000, None, "s"), (904, (FR + " ") * 3000, None, "s")], ["lang_pred", "score", "held_out"])
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = {r[0]: r[2] for r in rows()}
    assert all(got[i]["lang_pred"] == lang for i, lang in truth.items())
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == got[904]["lang_pred"] == "fr"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_mixture_has_both_languages(spark):
    docs = frame(spark, rows() + [(900, (EN + " " + FR + " ") * 20, None, "s")])
    found = langid.identify(docs).where("doc_id = 900").first()["proportions"]
    assert set(found) == {"en", "fr"} and abs(found["en"] - found["fr"]) < 0.3


def test_labels_are_not_inputs(spark):
    a = frame(spark, rows() + [(901, EN, None, "s")])
    b = frame(spark, rows() + [(901, EN, "zz", "t")])
    fitted = langid.fit(a.where("lang is not null"))
    one = langid.predict(a, fitted).where("doc_id = 901").first()["lang_pred"]
    assert one == langid.predict(b, fitted).where("doc_id = 901").first()["lang_pred"] == "en"


def test_nothing_to_learn_or_predict(spark):
    assert langid.identify(frame(spark, [])).count() == 0
    assert [r["lang_pred"] for r in langid.identify(frame(spark, [(1, EN, None, None)])).collect()] == ["und"]
    assert langid.keep_identified(frame(spark, rows() + [(900, "...", None, None)])).count() == len(rows())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs.select("doc_id", "text", "lang")).where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found) > 0


def test_every_letter_has_a_trigram():
    for text in ("\uff46\uff55\uff4c\uff4c", "\uff76\uff85", "\ufe8d\ufedf", "\U0001e922\U0001e923", "\u3005", "\u6f22", "\ud55c", "a"):
        assert len(langid.trigram_counts(text)[0]), text
    assert not len(langid.trigram_counts("12 \u3000\u3001 \U0001f600")[0])
