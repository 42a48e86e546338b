import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from linkwright.llm import tokenfile
from linkwright.llm.common import new_path
from tokenizers import Tokenizer

from .helpers import DE, EN, FR, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows():
    rng = random.Random(3)
    texts = [None, "", " ", EN, FR, DE, "日本語 и русский\ttab", "<|endoftext|> x", "a  b\n\n c ,. d", (EN + ".\n" + DE + ", ") * 2000, "same", "same"]
    texts += ["".join(rng.choice(" ,.\n'sab1é!_-") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    out = [((i * 7) % 1000, t, None, None) for i, t in enumerate(texts)]
    return [*out, (None, "no id", None, None), (7, "twice", None, None), (7, "twice", None, None)]


def expected():
    tokenizer = Tokenizer.from_file(PATH)
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for doc_id, text, _, _ in ordered:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_round_trip(spark):
    path = new_path(spark, "ids")
    docs = frame(spark, rows(), ["start", "ids"])
    manifest = tokenfile.write(docs, path, PATH, shards=3, block=5000)
    back = [tuple(r) for r in tokenfile.read(spark, path, manifest, ids=True).collect()]
    assert sorted(back, key=lambda r: r[1]) == expected()


def test_files_are_the_same_whatever_the_partitioning(spark):
    docs = frame(spark, rows())
    one, two = (sorted(map(tuple, tokenfile.write(d, new_path(spark, "ids"), PATH, shards=3).collect())) for d in (docs, docs.repartition(5)))
    assert one == two


def test_empty(spark):
    assert tokenfile.encode_and_read(frame(spark, []), new_path(spark, "ids"), PATH).count() == 0


def test_grammar_is_exact_and_saves_symbols():
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 50_257, 9) for _ in range(40)]
    docs = [np.concatenate([phrases[i] for i in rng.integers(0, 40, n)]).astype(np.uint16) for n in (1, 500, 1, 900, 300, 1)] + [np.full(4000, 7, np.uint16)]
    data, symbols = tokenfile.pack(list(range(len(docs))), docs)
    block = tokenfile.Block(data)
    assert symbols < sum(map(len, docs)) / 2 and len(block.size) > tokenfile.BASE
    assert (block.ids() == np.concatenate(docs)).all()
    for k, x in enumerate(docs):
        assert (block.document(k) == x).all()
        assert all(block.token(k, i) == x[i] for i in rng.integers(0, len(x), 20))


def test_encoder_forgets_and_learns_again():
    e, tokenizer = tokenfile.Encoder(PATH, 20), Tokenizer.from_file(PATH)
    for text in (EN, FR, DE, EN + "," + FR, "x!." + DE):
        assert list(e.encode([text])[0]) == tokenizer.encode(text, add_special_tokens=False).ids


def test_damage_is_noticed(spark):
    path = new_path(spark, "ids")
    manifest = tokenfile.write(frame(spark, rows()), path, PATH, shards=1)
    name = f"{path.removeprefix('file://')}/{manifest.first()['file']}"
    data = open(name, "rb").read()
    open(name, "wb").write(data[:8] + b"XXXX" + data[12:])
    with pytest.raises(Exception, match="not a block"):
        tokenfile.read(spark, path, manifest).count()


def test_rules_do_not_depend_on_the_size_of_a_block():
    import numpy as np

    from linkwright.llm import tokenfile

    ids = np.random.default_rng(3).integers(0, 50_000, 1 << 17).astype(np.uint16)
    ids[: 40 * 1000 : 1000], ids[1 : 40 * 1000 : 1000] = 7, 9
    rules, lengths, seq, _ = tokenfile.repair(ids, np.array([0]))
    assert [7, 9] in rules.tolist() and len(seq) <= len(ids) - 40


def test_ids_that_a_block_cannot_hold_are_refused(spark, tmp_path):
    from tokenizers.models import WordLevel

    Tokenizer(WordLevel({"a": 0, "b": tokenfile.BASE}, unk_token="a")).save(str(tmp_path / "wide.json"))
    with pytest.raises(ValueError, match="blocks hold ids below"):
        tokenfile.Encoder(str(tmp_path / "wide.json"))
    with pytest.raises(ValueError, match="end id"):
        tokenfile.write(frame(spark, rows()), new_path(spark, "ids"), PATH, end_id=tokenfile.BASE)


def test_pieces_encoded_together_are_as_encoded_alone():
    r = random.Random(5)
    letters = " \n,.'sSdllvet1é9!_-$#<|>¡ÀßŁ½²ªº×÷ab"
    e, tokenizer = tokenfile.Encoder(PATH, 5000), Tokenizer.from_file(PATH)
    for _ in range(40):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(32)]
        texts += [" ".join("".join(r.choice(letters[2:]) for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 30))) for _ in range(32)]
        assert [x.tolist() for x in e.encode(texts)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("frequent", [2, 3, 16])
def test_grammar_expands_to_ids_and_documents(frequent):
    rng = np.random.default_rng(frequent)
    for _ in range(40):
        size = int(rng.integers(1, 2000))
        ids = rng.integers(0, rng.integers(2, 40), size).astype(np.uint16)
        firsts = np.unique(np.append(0, rng.integers(0, size, rng.integers(0, 40))))
        rules, lengths, symbols, begins = tokenfile.repair(ids, firsts, frequent)
        flat, start, length = tokenfile.expansions(rules, lengths)
        parts = [flat[start[x] : start[x] + length[x]] for x in symbols]
        assert (np.concatenate(parts) == ids).all()
        ends = np.append(0, np.cumsum([len(x) for x in parts]))
        assert (ends[begins] == firsts).all()
