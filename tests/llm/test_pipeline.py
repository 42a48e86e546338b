import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from linkwright.llm import mixing
from tokenizers import Tokenizer

from .helpers import SF, shingle_set


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        frames[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert all(f.columns == ["doc_id", "text", "lang", "source", "n_chars"] for n, f in frames.items() if n != "token_ids")
    ids = lambda n: sorted(r["doc_id"] for r in frames[n].collect())
    letters = [i for i, r in rows.items() if r["text"] and any(c.isalpha() for c in r["text"])]
    assert ids("language_id") == sorted(letters)

    sets = {i: shingle_set(rows[i]["text"], 5) for i in letters}
    root = {i: i for i in letters}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in letters:
        for j in letters:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    unique = sorted(i for i in letters if find(i) == i)
    assert ids("ngram_jaccard_join") == unique

    items = [shingle_set(r["text"], 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [i for i in unique if not any(len(s & sets[i]) >= 0.8 * len(s) for s in items)]
    assert ids("benchmark_decontamination") == clean

    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(frames["benchmark_decontamination"]).collect()}
    assert ids("mixing_sources") == sorted(i for i in clean for _ in range(plan[i]))

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r, i in zip(sorted(frames["token_ids"].collect(), key=lambda r: r["start"]), ids("mixing_sources"), strict=True):
        found = [*tokenizer.encode(rows[i]["text"], add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes()))
        start += len(found)


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in __spark_entry__.queries()}
