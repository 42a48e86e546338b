from linkwright.llm import mixing

from .helpers import frame, words


def fill(sizes, weights, most):
    """Targets by sharing again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest, open_ = total - sum(most * sizes[s] for s in full), [s for s in names if s not in full]
        w = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in open_ if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def rows():
    out = [(i, "w " * (1 + i % 40), None, ["a", "b", "c", "d", None][i % 5] if i < 2000 else "hot") for i in range(6000)]
    return out + [(9000, None, None, "a"), (9001, "", None, "nothing"), (9002, "x " * 20_000, None, "b"), (5, "w " * 6, None, "a")]


def test_targets_and_copies(spark):
    docs = frame(spark, rows(), ["size", "target", "copies"])
    found = mixing.mix_plan(docs).collect()
    sizes = {}
    for _, text, _, source in rows():
        sizes[source] = sizes.get(source, 0) + len(words(text))
    expected = fill(sizes, (1, 2, 3), 3.0)
    assert len(found) == len(rows())
    assert all(abs(r["target"] - expected[r["source"]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[r["source"]] for r in found)
    assert all(0 <= r["copies"] <= 3 and r["copies"] - r["rate"] < 1 and r["rate"] - r["copies"] < 1 for r in found)
    for source in ("hot", "c", "d"):
        taken = sum(r["size"] * r["copies"] for r in found if r["source"] == source)
        assert abs(taken - expected[source]) < 0.1 * expected[source]
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in found) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_large_source_table_and_mix(spark, monkeypatch):
    docs = frame(spark, rows())
    small = {(r["doc_id"], r["copies"]) for r in mixing.mix_plan(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert small == {(r["doc_id"], r["copies"]) for r in mixing.mix_plan(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in mixing.mix_plan(docs).collect())


def test_empty(spark):
    assert mixing.mix_plan(frame(spark, [])).count() == 0
    assert [r["copies"] for r in mixing.mix_plan(frame(spark, [(1, None, None, None)])).collect()] == [0]
