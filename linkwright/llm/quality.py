"""Quality rules with line sequence labelling.

Base counts of a whole text decide first; a text that passes them is labelled line by line, content or boilerplate, by Viterbi
decoding of a linear-chain conditional random field, and kept if content makes up enough of its words.

A word is a run outside ``\\x20\\x09-\\x0D``.  Null and empty texts have no words and fail the base rules.  Lines are parted by
``\\n``; lines without a word are not labelled.  Texts are taken whole.  Rows that repeat are judged alike, and columns that the
operator adds replace columns of the same name.

The field is trained on the lines of a bounded sample of documents with a quality label, chosen by a hash of doc_id, so that a run
repeats; of rows that repeat a doc_id, the least text.  Lines of bad documents are boilerplate, lines of good ones are content but
for those that also stand in several other good documents, unless those share most of their lines and are thus copies.  Training
sequences join a piece of a good document and one of a bad one, in either order, so that labels change within them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import saved
from .wordhash import shingles, words

#: A line of a good document that stands in so many of the sample is boilerplate.
RECURRENT = 3
#: Documents of each label used for training; longest run of lines in a piece of one; steps; step size; L2 penalty.
FIT_DOCUMENTS, RUN, STEPS, RATE, PENALTY = 600, 64, 150, 0.3, 1e-3
LEAST_WORDS, LEAST_CONTENT = 50, 0.3
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_SYMBOLS = re.compile(r"[#*$%&|<>]").findall
_END = re.compile(r"[.,;:!?]\Z").search
#: Bounds that turn a line's measures into features.
SHARES, WORDS, LENGTHS = (0.02, 0.1, 0.3), (2, 4, 8, 16, 32, 64), (2.5, 4, 6, 9, 14)
FEATURES = 1 + 4 * (len(SHARES) + 1) + (len(WORDS) + 1) + (len(LENGTHS) + 1) + 4


def line_features(lines: list[str]) -> np.ndarray:
    """A row of numbers of binary features for each line."""
    out = np.empty((len(lines), 11), np.int64)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        found = _WORDS(line)
        n, chars = max(1, len(found)), max(1, len(line))
        shares = (len(_SYMBOLS(line)) / chars, sum(map(str.isupper, found)) / n, line.count("!") / n, 1 - len(set(found)) / n)
        at = 1
        row = [0]
        for x in shares:
            row.append(at + sum(x >= b for b in SHARES))
            at += len(SHARES) + 1
        row.append(at + sum(n >= b for b in WORDS))
        at += len(WORDS) + 1
        row.append(at + sum(chars / n >= b for b in LENGTHS))
        at += len(LENGTHS) + 1
        row.append(at + (1 if line in seen else 0))
        row.append(at + 2 + (1 if _END(line.rstrip()) else 0))
        row += row[-1:] * (11 - len(row))
        seen.add(line)
        out[i] = row
    return out


def emissions(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Scores of both labels for each line; a feature that fills the row up again counts once."""
    return weights[features[:, :9]].sum(1)


def viterbi(scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best labels (0 boilerplate, 1 content); steps[a, b] is the score of b after a."""
    (s00, s01), (s10, s11) = steps.tolist()
    rows = scores.tolist()
    a, b = rows[0]
    back = []
    for x, y in rows[1:]:
        back.append((a + s00 < b + s10, a + s01 < b + s11))
        a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
    label = int(b >= a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return np.array(out[::-1])


def line_labels(documents: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """A label for each line of documents of (quality, line hashes)."""
    spread = Counter(h for quality, hashes in documents if quality for h in set(hashes.tolist()))
    out = []
    for quality, hashes in documents:
        recurs = np.array([spread[h] >= RECURRENT for h in hashes.tolist()])
        out.append(np.where(recurs & (2 * recurs.sum() <= len(recurs)), 0, 1) if quality else np.zeros(len(hashes), int))
    return out


def mixed(documents: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences of line features and labels, a piece of a good document and one of a bad one each, from (quality, features, labels)."""
    good, bad = ([(x[at : at + RUN], y[at : at + RUN]) for q, x, y in documents if q == quality for at in range(0, len(x), RUN)] for quality in (1, 0))
    if not good or not bad:
        return []
    pairs = ((good[i % len(good)], bad[i % len(bad)]) for i in range(max(len(good), len(bad))))
    return [tuple(np.concatenate(part) for part in zip(*(pair if i % 2 else pair[::-1]), strict=True)) for i, pair in enumerate(pairs)]


def train(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 2) and steps (2, 2) from sequences of line features and line labels, by gradient ascent."""
    weights, steps = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    sequences = [(x[:, :9], y) for x, y in sequences]
    if not sequences:
        weights[0, 1] = 1.0  # nothing to tell apart: all lines are content
        return weights, steps
    n, longest = len(sequences), max(len(x) for x, _ in sequences)
    feature = np.zeros((n, longest, 9), np.int64)
    there = np.zeros((n, longest), bool)
    label = np.zeros((n, longest), int)
    for i, (x, y) in enumerate(sequences):
        feature[i, : len(x)], there[i, : len(x)], label[i, : len(x)] = x, True, y
    own = np.stack((there & (label == 0), there & (label == 1)), 2).astype(float)
    seen = np.einsum("nta,ntb->ab", own[:, :-1], own[:, 1:])
    lines = there.sum()
    for _ in range(STEPS):
        e = weights[feature].sum(2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = e[:, t] + np.logaddexp(forward[:, t - 1, :1] + steps[0], forward[:, t - 1, 1:] + steps[1])
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp(steps[:, 0] + (e[:, t + 1, 0] + backward[:, t + 1, 0])[:, None], steps[:, 1] + (e[:, t + 1, 1] + backward[:, t + 1, 1])[:, None])
            backward[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p = np.exp(np.where(there[:, :, None], forward + backward - z[:, None, None], -np.inf))
        gap = (own - p) / n
        up = np.zeros_like(weights)
        for k in range(9):
            np.add.at(up, feature[:, :, k].ravel(), gap.reshape(-1, 2))
        pair = np.exp(forward[:, :-1, :, None] + steps + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        turn = (seen - pair.sum((0, 1))) / n
        scale = RATE * n / lines
        weights += scale * (up * 4 - PENALTY * weights)
        steps += scale * (turn - PENALTY * steps)
    return weights, steps


def content_share(text: str, model: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the words in lines labelled content."""
    lines = [x for x in text.split("\n") if _WORDS(x)]
    if not lines:
        return 0.0
    n = np.array([len(_WORDS(x)) for x in lines])
    weights, steps = model
    return float(n @ viterbi(emissions(weights, line_features(lines)), steps) / n.sum())


def base_counts(texts: pa.Array) -> Iterator[tuple[int, int, int]]:
    """n_words, word_chars, n_repeat_words of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for _, counts, hashes, starts, ends, data in words(texts, fold=False, data=True):
        begun = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=begun[1:])
        chars = np.append(0, np.cumsum(begun[ends] - begun[starts]))
        at = 0
        for n in counts.tolist():
            repeated = 0
            if n >= 4:
                _, which, times = np.unique(shingles(hashes[at : at + n], 3), return_inverse=True, return_counts=True)
                again = times[which] > 1
                if again.any():
                    covered = np.zeros(n, bool)
                    covered[:-2] |= again
                    covered[1:-1] |= again
                    covered[2:] |= again
                    repeated = int(covered.sum())
            yield n, int(chars[at + n] - chars[at]), repeated
            at += n


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if _WORDS(x)]
    return len(lines) - len(set(lines))


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """The field from documents with a quality label; up to ``documents`` of each label come to the driver, as line features."""
    labels = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    bad, good = (labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents) for q in (0, 1))
    chosen = saved(bad.unionByName(good), "chosen")
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(int(q), line_features(x).astype(np.int16).tobytes(), np.array([xxh64_intdigest(y) for y in x], np.uint64).tobytes()) for q, t in zip(batch["quality"], batch["text"], strict=True) if (x := [y for y in t.split("\n") if _WORDS(y)])]
            yield pd.DataFrame(rows, columns=["quality", "features", "hashes"])

    rows = texts.mapInPandas(measure, "quality int, features binary, hashes binary").toLocalIterator()
    # equal texts count once
    found = sorted({(r["quality"], bytes(r["features"]), bytes(r["hashes"])) for r in rows})
    labels_of = line_labels([(q, np.frombuffer(h, np.uint64)) for q, _, h in found])
    return train(mixed([(q, np.frombuffer(x, np.int16).reshape(-1, 11).astype(np.int64), y) for (q, x, _), y in zip(found, labels_of, strict=True)]))


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share and kept."""
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")
    docs = docs.drop(*own)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = shared.value
        for texts in batches:
            values = [x or "" for x in texts]
            rows = []
            for text, (n, chars, repeated) in zip(values, base_counts(pa.array(values, pa.large_string())), strict=True):
                failed = n < LEAST_WORDS or 100 * repeated > 50 * n
                share = content_share(text, field)
                rows.append((n, chars, len(_SYMBOLS(text)), duplicate_lines(text), repeated, failed, share, not failed and share >= LEAST_CONTENT))
            yield pd.DataFrame(rows, columns=own)

    out = docs.withColumn("_rules", rules("text"))
    return out.select(*docs.columns, "_rules.*")
