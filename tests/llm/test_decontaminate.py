import random

from linkwright.llm import common, decontaminate

from .helpers import frame, shingle_set


def data():
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "too few words"), (103, items[3][1]), (104, items[4][1].upper()), (105, "five words and no more"), (106, "What is love"), (107, "unheard")]
    docs = [(i, " ".join(word() for _ in range(rng.choice((3, 30, 300, 3000)))), None, None) for i in range(120)]
    for i in range(80):
        w = items[i % 60][1].split()
        for _ in range(i // 30):
            w[rng.randrange(len(w))] = word()
        around = [word() for _ in range(rng.choice((0, 20, 4000)))]
        docs.append((1000 + i, " ".join([*around[: len(around) // 2], *w, *around[len(around) // 2 :]]), None, None))
    docs += [(5000, None, None, None), (5001, "", None, None), (5002, "said: FIVE words\nand no  more today", None, None), (5003, "he asked what is\nlove and went", None, None), (5004, "what is  LOVE", None, None), (5005, "love is what", None, None), (1000, docs[120][1], None, None), (None, items[7][1], None, None)]
    return docs, items


def brute(docs, items):
    out = {}
    for item, text in items:
        k = min(5, len((text or "").split()))
        s = shingle_set(text, k) if k else set()
        for doc_id, body, _, _ in docs:
            n = len(s & shingle_set(body, k)) if s else 0
            if s and n >= 0.8 * len(s):
                out[doc_id, item] = max(n, out.get((doc_id, item), 0))
    return out


def test_against_brute_force(spark, monkeypatch):
    docs, items = data()
    bench = spark.createDataFrame([(i, t, "mine") for i, t in items], "item_id long, text string, doc_id string")
    df = frame(spark, docs, ["item_id", "part"])
    for size in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", size)
        found = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in decontaminate.contained(df, bench).collect()}
        assert found == brute(docs, items)


def test_clean_keeps_the_rest(spark):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    kept = decontaminate.clean(df, bench)
    bad = {d for d, _ in brute(docs, items)}
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d[0] for d in docs if d[0] not in bad)


def test_empty(spark):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contained(frame(spark, []), bench).count() == 0
    assert decontaminate.contained(frame(spark, docs[:5]), bench.limit(0)).count() == 0
