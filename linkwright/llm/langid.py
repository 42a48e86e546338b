"""Language ID by multilingual mixture inference.

Every language has a distribution over hashed character trigrams, learned from labelled texts.  A document's trigrams are taken to
be drawn from a mixture of languages; expectation-maximisation estimates the proportions.  Languages are added one at a time as
long as the log-likelihood grows by more than the penalty of a further proportion.  The prediction is the language with the
largest proportion, and the score is that proportion.

Only the text enters a prediction.  Null texts and texts without a letter are ``und`` with score 0; so is every text if nothing
was labelled.  Texts are taken whole, cut only into slices whose trigram counts add up.  Rows that repeat are predicted alike.
Columns that the operator adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigram classes; labelled documents of one language used for fitting, about; smoothing; Baum-Welch style steps.
CLASSES, FIT_DOCUMENTS, SMOOTHING, STEPS = 1 << 16, 4000, 0.05, 30
#: Neighbouring trigrams share letters: this many count as one independent draw in the penalty.
DEPENDENT = 3.0
SLICE = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.zeros(0x110000, np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _fold() -> np.ndarray:
    """Code points to small numbers: letters lower-cased, everything else one blank."""
    if not _FOLD[97]:
        for c in range(len(_FOLD)):
            x = chr(c)
            if x.isalpha():
                _FOLD[c] = ord(x.lower()[0])
    return _FOLD


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Classes and counts of the trigrams of letters and blanks of a whole text."""
    total: dict[int, int] | None = None
    out = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for at in range(0, max(1, len(text)), SLICE):
        x = _fold()[np.frombuffer(f" {text[max(0, at - 2) : at + SLICE]} ".encode("utf-32-le", "replace"), np.uint32)]
        x = x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]]  # runs of blanks as one
        if len(x) < 3:
            continue
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        new = np.unique(h[x[1:-1] != 0].astype(np.int64) % CLASSES, return_counts=True)
        if len(text) <= SLICE:
            return new
        total = total or {}
        for k, v in zip(*map(np.ndarray.tolist, new), strict=True):
            total[k] = total.get(k, 0) + v
    if total:
        out = np.array(list(total)), np.array(list(total.values()))
    return out


def _em(p: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and proportions of a mixture of the rows of p."""
    share = np.full(len(p), 1 / len(p))
    for _ in range(STEPS if len(p) > 1 else 1):
        joint = share[:, None] * p
        new = (joint / joint.sum(0)) @ n / n.sum()
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return float(np.log(share @ p) @ n), share


def mixture(logs: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportion of each language; logs has a row of log-probabilities for each."""
    at = logs[:, keys]
    p = np.exp(at - at.max(0))
    penalty = 0.5 * np.log(max(2.0, n.sum() / DEPENDENT)) * DEPENDENT
    alone = np.log(p) @ n
    chosen = [int(alone.argmax())]
    best, share = float(alone.max()), np.ones(1)
    while len(chosen) < len(logs):
        # the candidate with the steepest likelihood at proportion 0 is tried
        slope = (p / (share @ p[chosen])) @ n
        slope[chosen] = -np.inf
        more = [*chosen, int(slope.argmax())]
        if slope.max() <= n.sum():
            break
        value, new = _em(p[more], n)
        if value - best <= penalty:
            break
        chosen, best, share = more, value, new
    out = np.zeros(len(logs))
    out[chosen] = share
    return out


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities, from rows of (text, lang); about ``documents`` of each language, chosen by a hash of the text.

    What comes to the driver is one count for each language and trigram class.
    """
    labelled = docs.where("lang is not null and text is not null").select("text", "lang")
    sizes = labelled.groupBy("lang").count().withColumn("_share", F.least(F.lit(1.0), F.lit(float(documents)) / F.col("count"))).select(F.col("lang").alias("_lang"), "_share")
    chosen = labelled.join(F.broadcast(sizes), F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("_share") * (1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                keys, n = trigram_counts(text)
                sums.setdefault(lang, np.zeros(CLASSES, np.int64))[keys] += n
        for lang, n in sums.items():
            keys = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "k": keys, "n": n[keys]})

    rows = chosen.select("text", "lang").mapInPandas(count, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    counts = np.zeros((len(names), CLASSES))
    for i, name in enumerate(names):
        own = rows[rows["lang"] == name]
        counts[i, own["k"]] = own["n"]
    counts += SMOOTHING
    return names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred, score and proportions (of the languages found, by name)."""
    spark = docs.sparkSession
    names = model[0]
    shared = spark.sparkContext.broadcast(model[1])
    docs = docs.drop("lang_pred", "score", "proportions")
    schema = "lang_pred string, score double, proportions map<string, double>"

    @F.pandas_udf(schema)
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        logs = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                keys, n = trigram_counts(text) if text and names and _LETTER.search(text) else ((), ())
                if len(keys) == 0:
                    rows.append(("und", 0.0, {}))
                    continue
                share = mixture(logs, keys, n.astype(np.float64))
                best = int(share.argmax())
                rows.append((names[best], min(1.0, float(share[best])), {names[i]: float(share[i]) for i in np.flatnonzero(share)}))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "proportions"])

    out = docs.withColumn("_found", infer("text"))
    return out.select(*docs.columns, "_found.*")


def identify(docs: DataFrame, documents: int = FIT_DOCUMENTS) -> DataFrame:
    """held_out and predictions for docs (doc_id, text, lang); only labelled rows that are not held out are learned from."""
    docs = docs.drop("held_out")
    model = fit(docs.where(~held_out(F.col("doc_id"))), documents)
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)


def keep_identified(docs: DataFrame, documents: int = FIT_DOCUMENTS) -> DataFrame:
    """The documents, with their own columns, for which a language was found."""
    return identify(docs, documents).where("lang_pred <> 'und'").select(*docs.columns)
