"""Small documents with nulls, empty and long texts, repeated rows and clashing columns."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
EN = "the and of that with there is another thing in the other house and they were thinking about nothing"
FR = "le la les des une dans pour que qui avec cette maison et nous sommes venus pour parler de rien"
DE = "der die das und ist nicht mit einer auf dem haus wir haben nichts zu sagen über diese sache"


def frame(spark, rows, extra=()):
    """rows of (doc_id, text, lang, source); extra names columns that clash with what operators add."""
    df = spark.createDataFrame([(i, t, a, s, len(t or "")) for i, t, a, s in rows], SCHEMA)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("mine"))
    return df


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
