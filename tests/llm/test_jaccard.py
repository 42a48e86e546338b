import random

import pytest
from linkwright.llm import jaccard

from .helpers import EN, FR, frame, shingle_set


def brute(rows, k, percent):
    sets = [shingle_set(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    return sorted((r[0], len(sets[i]), min(least[find(i)])) for i, r in enumerate(rows))


def rows(n=160, hot=60):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    out = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one two three four"), (7, EN), (8, EN.upper()), (9, FR), (9, FR), (9, FR)]
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        out.append((100 + i, " ".join(w)))
        for j in range(rng.choice((0, 0, 1, 3))):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            out.append((10_000 + 10 * i + j, " ".join(v)))
        if i % 5 == 0:
            out.append((50_000 + i, " ".join(shared + w)))
    base = [rng.choice(vocabulary) for _ in range(90)]
    for i in range(hot):
        v = list(base)
        for _ in range(rng.randint(0, 4)):
            v[rng.randrange(len(v))] = f"h{rng.randrange(10**6)}"
        out.append((70_000 + i, " ".join(v)))
    out.append((90_000, " ".join(vocabulary * 100)))
    return [(i, t, None, None) for i, t in out]


@pytest.mark.parametrize(("k", "percent", "long", "block"), [(4, 85, 128, 1024), (5, 80, 3, 8), (2, 60, 5, 16)])
def test_against_brute_force(spark, monkeypatch, k, percent, long, block):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CHUNK", 2000)
    docs = frame(spark, rows(), ["component_id", "key", "tokens"])
    assert sorted(map(tuple, jaccard.near_copies(docs, k, percent).collect())) == brute(rows(), k, percent)


def test_result_does_not_depend_on_partitions(spark):
    docs = frame(spark, rows(40, 20))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        many = sorted(map(tuple, jaccard.near_copies(docs.repartition(9)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert many == sorted(map(tuple, jaccard.near_copies(docs).collect()))


def test_one_of_each(spark):
    docs = frame(spark, rows(40, 20))
    kept = jaccard.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[2] for r in brute(rows(40, 20), 4, 85)})


def test_empty(spark):
    assert jaccard.near_copies(frame(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.near_copies(frame(spark, [(1, None, None, None)])).collect()] == [(1, 0, 1)]


def test_one_of_each_goes_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    docs = frame(spark, [(1, a, None, None), (2, a + " end", None, None), (2, b, None, None), (3, c, None, None), (3, d, None, None), (None, a, None, None), (None, d + " end", None, None)])
    kept = sorted((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs, 4, 85).collect())
    assert kept == [(1, a), (2, b), (3, c), (3, d)]
