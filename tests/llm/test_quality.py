import re
from collections import Counter

from linkwright.llm import quality

from .helpers import EN, SF, frame


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def good(i):
    w = EN.split()
    return ".\n".join(" ".join(w[(i * k * j) % len(w)] + str(k) for k in range(1, 13)).capitalize() for j in range(1, 7))


def bad(i):
    w = EN.split()
    return "\n".join(" ".join(w[(i * k + j) % len(w)].upper() + str(k) + "%%%" for k in range(1, 13)) for j in range(1, 7))


def test_base_counts_and_retention(spark):
    docs = [(i, good(i) if i % 2 else bad(i), None, None) for i in range(200)]
    docs += [(900, None, None, None), (901, "", None, None), (902, "\n \n", None, None), (903, "a b c a b c " * 30, None, None), (904, (good(3) + "\n") * 400, None, None), (905, good(5), None, None), (905, good(5), None, None), (906, "x\n\nx\n x\nx", None, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(900, 1, 0), (901, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, docs, ["kept", "n_words"])
    found = quality.judge(df, quality.fit(df, labels)).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(docs)
    for doc_id, text, _, _ in docs:
        r = by[doc_id]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == counts(text), doc_id
    assert all(by[i]["kept"] == (i % 2 == 1 and not by[i]["base_failed"]) for i in range(150, 200))
    assert sum(by[i]["kept"] for i in range(150, 200)) > 10
    assert not any(by[i]["kept"] for i in (900, 901, 902, 903, 904))


def test_nothing_labelled_or_empty(spark):
    df = frame(spark, [(1, good(1), None, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(df, quality.fit(df, none)).first()["kept"]
    assert quality.judge(df.limit(0), quality.fit(df, none)).count() == 0


def test_lines_of_one_text_get_both_labels(spark):
    """A good document with boilerplate below it, in a corpus whose good documents share a footer."""
    import numpy as np

    footer = "home about contact privacy terms\nall rights reserved by the owner"
    own = lambda i: "\n".join(f"{line} no{i}." for line in good(i).split("\n"))
    docs = [(i, own(i) + "\n" + footer if i % 2 else bad(i), None, None) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    weights, steps = quality.fit(frame(spark, docs), labels)

    def found(text):
        return quality.viterbi(quality.emissions(weights, quality.line_features(text.split("\n"))), steps).tolist()

    assert found(own(151) + "\n" + footer) == [1] * 6 + [0] * 2
    assert found(bad(152) + "\n" + own(153)) == [0] * 6 + [1] * 6
    assert found(own(155) + "\n" + bad(154)) == [1] * 6 + [0] * 6
    assert np.array_equal(steps, quality.fit(frame(spark, docs + docs[:50]), labels)[1])  # repeated rows change nothing


def test_line_labels():
    import numpy as np

    docs = [(1, [1, 9]), (1, [2, 9]), (1, [3, 9]), (0, [9, 4]), (1, [5, 6, 7]), (1, [5, 6, 7, 8]), (1, [5, 6, 7, 10])]
    found = quality.line_labels([(q, np.array(h, np.uint64)) for q, h in docs])
    assert [x.tolist() for x in found] == [[1, 0], [1, 0], [1, 0], [0, 0], [1, 1, 1], [1, 1, 1, 1], [1, 1, 1, 1]]


def test_viterbi_finds_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for n in range(1, 7):
        scores, steps = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda p, s=scores, t=steps: sum(s[i][y] for i, y in enumerate(p)) + sum(t[a][b] for a, b in itertools.pairwise(p))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(quality.viterbi(scores, steps)) == best


def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs.select("doc_id", "text"), quality.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    right = [r["kept"] == (r["quality"] == 1) for r in rows]
    assert sum(right) >= 0.97 * len(right)
