"""Token ids in Re-Pair compressed files with random access.

Texts are encoded with a public tokenizer of the tokenizers library, an end id is appended to each, and the ids are written in
ascending doc_id order: range shards, a file for each, independent blocks of about ``BLOCK`` ids in a file.  A block holds a
grammar: frequent pairs of neighbouring symbols are replaced by nonterminals, again and again, never across documents; stored are
the rules, the expansion length of each, the symbols and where each document begins.  A reader decodes any document, or finds any
id in it, without touching the others.

A null or empty text is the end id alone.  Rows that repeat a doc_id follow each other in the order of their texts; a null doc_id
comes first.  Texts are encoded whole, however long.  Other columns are ignored.

Block layout, little-endian: ``RPB1``, uint32 documents, rules, symbols; int64 doc_ids; uint8 doc_id is null; uint64 ids of each
document; uint64 first symbol of each document; uint16 rules (left, right); uint32 expansion lengths; uint16 symbols.  Symbols
below ``BASE`` are ids, ``BASE + k`` is rule k.  A file is its blocks one after another, each with a uint64 length before it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import give_back
from .shards import NewFile, commit_manifest, cut_points, open_store, shard_count, sharded

#: Ids in a block, first nonterminal, pairs looked at in a round.
BLOCK, BASE, PAIRS = 1 << 20, 50_258, 512
#: A pair is frequent with this many occurrences.
LEAST = 16
#: Distinct pieces of text that a worker remembers, at about 200 bytes each.
PIECES = 1_500_000
MANIFEST = "file string, shard int, documents long, ids long, symbols long, bytes long, base long"
#: Fixed value: how the byte-level tokenizer splits text before it merges; each piece is encoded by itself.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a piece may begin with to be encoded together with others.
BEGINS, BLANK = " \n", re.compile(r"\s")


class Numbered(dict):
    """Numbers what it is asked for, from 0."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Table:
    """Ids of numbered pieces of text, behind each other."""

    def __init__(self):
        self.known = Numbered()
        self.lengths, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def add(self, found: list[np.ndarray], lengths: np.ndarray, order: list[int]) -> None:
        """Ids of the next pieces, where found[i] has those of one or more pieces, all together in the given order."""
        own = lengths[order]
        starts = np.zeros(len(lengths), np.int64)
        starts[order] = len(self.ids) + np.cumsum(own) - own
        self.lengths, self.starts = np.concatenate([self.lengths, lengths]), np.concatenate([self.starts, starts])
        self.ids = np.concatenate([self.ids, *found])

    def look_up(self, place: np.ndarray, counts: list[int]) -> list[np.ndarray]:
        lengths = self.lengths[place]
        total = np.cumsum(lengths)
        flat = self.ids[np.repeat(self.starts[place] - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)]
        return np.split(flat, np.append(0, total)[np.cumsum(counts)][:-1])


class Encoder:
    """Encodes texts with a tokenizer file; pieces that recur are looked up, new ones go to the tokenizer.

    A byte-level tokenizer encodes each piece that ``SPLIT`` finds by itself.  Most texts are cut more cheaply, before each blank,
    comma, stop and line end, where a piece always begins unless blanks or signs come together; texts with such places are split
    by the pattern.  Texts with other than letters and signs that all Unicode versions agree on go to the tokenizer whole, as do
    texts with one of its special tokens, and all texts if it does not split as byte-level tokenizers do.
    """

    def __init__(self, path: str, most: int = PIECES):
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if (top := max(vocabulary.values(), default=0)) >= BASE:
            raise ValueError(f"{path} has ids up to {top}; blocks hold ids below {BASE}")
        # blank and line end, as byte-level vocabularies write them: a piece that begins with one has no other token that does
        self.begins = np.zeros(BASE, bool)
        self.begins[[i for x, i in vocabulary.items() if x[:1] in ("\u0120", "\u010a")]] = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and (spec.get("post_processor") or {}).get("type") in (None, "ByteLevel")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.split = regex.compile(SPLIT).findall
        self.odd = re.compile("[^\n\x20-\x7e\xa1-\u024f]").search
        self.signs = re.compile("[!-/:-@\\[-`{-\xbf\xd7\xf7][.,]").search
        self.units, self.pieces = Table(), Table()

    def _learn(self, table: Table, new: list[str]) -> None:
        """Ids of new pieces; those that only begin with a blank or line end are encoded many at a time, as the tokenizer parts them again."""
        lengths = np.zeros(len(new), np.int64)
        order, ids, rest = [], [], []
        words, inner = [], BLANK.search
        for i, x in enumerate(new):
            (words if len(x) > 1 and x[0] in BEGINS and not inner(x, 1) else rest).append(i)
        for at in range(0, len(words), 500):
            run = words[at : at + 500]
            found = np.array(self.tokenizer.encode_batch_fast(["".join([new[i] for i in run])], add_special_tokens=False)[0].ids, np.uint16)
            begins = np.flatnonzero(self.begins[found])
            if len(begins) != len(run) or begins[0]:
                raise ValueError("the tokenizer does not split words as expected")
            lengths[run] = np.diff(np.append(begins, len(found)))
            order.extend(run)
            ids.append(found)
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False) if rest else (), strict=True):
            lengths[i] = len(x.ids)
            order.append(i)
            ids.append(np.array(x.ids, np.uint16))
        table.add(ids, lengths, order)

    def _through(self, table: Table, cut: list[list[str]], text_of) -> list[np.ndarray]:
        first = len(table.known)
        number = table.known.__getitem__
        place = np.concatenate([np.fromiter(map(number, x), np.int64, len(x)) for x in cut])
        if len(table.known) > first:
            self._learn(table, [text_of(x) for x in islice(reversed(table.known), len(table.known) - first)][::-1])
        return table.look_up(place, [len(x) for x in cut])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        whole, units, pieces = [], [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint16)
            elif not self.plain or self.odd(text) or any(s in text for s in self.special):
                whole.append(i)
            else:
                marked = "\x05" + text.replace(",", " \x02").replace(".", " \x03").replace("\n", " \x04")
                if "  " in marked or "\n\n" in text or self.signs(text):
                    pieces.append((i, self.split(text)))
                else:
                    units.append((i, marked.split(" ")))
        for i, x in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else (), strict=True):
            out[i] = np.array(x.ids, np.uint16)
        for name, cut, text_of in (("units", units, _unit_text), ("pieces", pieces, str)):
            if len(getattr(self, name).known) > self.most:
                setattr(self, name, Table())
            if cut:
                for (i, _), x in zip(cut, self._through(getattr(self, name), [x for _, x in cut], text_of), strict=True):
                    out[i] = x
        return out


#: What stands at the head of a unit for the sign that it begins with; without one it begins with a blank.
MARKS = {"\x02": ",", "\x03": ".", "\x04": "\n", "\x05": ""}


def _unit_text(unit: str) -> str:
    head = MARKS.get(unit[:1])
    return f" {unit}" if head is None else head + unit[1:]


@lru_cache(1)
def encoder(path: str, most: int) -> Encoder:
    """One for each worker process and tokenizer, so that tasks share what it remembers."""
    return Encoder(path, most)


def repair(ids: np.ndarray, firsts: np.ndarray, frequent: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), expansion lengths, symbols and the first symbol of each document, for ids of documents that begin at firsts.

    Each round ranks the most frequent pairs, replaces every occurrence that outranks its neighbours, and keeps the rules that
    were used often enough; it ends when no pair is frequent or all symbols of 16 bits are taken.
    """
    frequent = max(frequent or LEAST, 2)
    seq, firsts = ids.astype(np.uint16), np.unique(firsts[firsts < len(ids)])
    rules, lengths = [], np.ones(1 << 16, np.uint32)
    used = BASE
    while len(seq) > 1 and used < 1 << 16:
        # no pair joins two documents: the code of such a place is above all others, and sorted off
        across = firsts[1:] - 1
        codes = seq[:-1].astype(np.uint32)
        codes <<= np.uint32(16)
        codes |= seq[1:]
        codes[across] = 0xFFFFFFFF
        codes.sort()
        codes = codes[: len(codes) - len(across)]
        if len(codes) < frequent:
            break
        # equal codes stand together, so that a frequent one stands again frequent - 1 places on, in a run for each
        again = np.zeros(len(codes) - frequent + 3, bool)
        again[1:-1] = codes[: len(codes) - frequent + 1] == codes[frequent - 1 :]
        edges = np.flatnonzero(again[1:] != again[:-1])
        if not len(edges):
            break
        marks, n = codes[edges[::2]], edges[1::2] - edges[::2] + frequent - 1
        best = np.lexsort((marks, -n))[: min(PAIRS, (1 << 16) - used)]
        pairs = marks[best]
        left, right = pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)
        rows, row_of = np.unique(left, return_inverse=True)
        columns, column_of = np.unique(right, return_inverse=True)
        row_at, column_at = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        row_at[rows], column_at[columns] = np.arange(len(rows)), np.arange(len(columns))
        table = np.full(len(rows) * len(columns), PAIRS, np.int16)
        table[row_of * len(columns) + column_of] = np.arange(len(pairs))
        # places whose symbols are the left and the right of some pair, then those where they are of the same
        side = np.zeros(1 << 16, np.uint8)
        side[columns] = 1
        side[rows] |= 2
        sides = side.take(seq)
        may = ((sides[:-1] >> 1) & sides[1:]).view(bool)
        may[across] = False
        at = np.flatnonzero(may)
        own = table[row_at[seq[at]] * np.int32(len(columns)) + column_at[seq[at + 1]]]
        hit = np.flatnonzero(own < PAIRS)
        at, own = at.take(hit), own.take(hit)
        # a place gives way to a neighbour of a better rank
        touch = at[1:] == at[:-1] + 1
        chosen = np.ones(len(at), bool)
        chosen[1:][touch & (own[1:] > own[:-1])] = False
        chosen[:-1][touch & (own[:-1] > own[1:])] = False
        # of a pair that overlaps itself, every other place: the first, third and so on in a row with one rank
        again = np.flatnonzero(touch & (own[1:] == own[:-1])) + 1
        if len(again):
            here = np.arange(len(again))
            begun = np.maximum.accumulate(np.where(np.append(True, np.diff(again) != 1), here, 0))
            chosen[again[(here - begun) % 2 == 0]] = False
        at, which = at[chosen], own[chosen]
        times = np.bincount(which, minlength=len(pairs))
        good = np.flatnonzero(times >= frequent // 2)
        if not len(good):
            break
        name = np.zeros(len(pairs), np.uint16)
        name[good] = np.arange(used, used + len(good))
        taken = times[which] >= frequent // 2
        at = at[taken]
        seq[at] = name[which[taken]]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        firsts = firsts - np.searchsorted(at, firsts)
        rules.append(np.stack([left[good], right[good]], 1).astype(np.uint16))
        lengths[used : used + len(good)] = lengths[left[good]] + lengths[right[good]]
        used += len(good)
    rule = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)
    return rule, lengths[BASE:used], seq, firsts


def expansions(rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols' expansions behind each other, with the start and length of each."""
    size = np.ones(BASE + len(rules), np.int64)
    size[BASE:] = lengths
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint16)
    flat[:BASE] = np.arange(BASE)
    for k, (a, b) in enumerate(rules.tolist()):
        at = start[BASE + k]
        flat[at : at + size[a]] = flat[start[a] : start[a] + size[a]]
        flat[at + size[a] : at + size[a] + size[b]] = flat[start[b] : start[b] + size[b]]
    return flat, start, size


class Block:
    """A block of a file; decodes all of it, one document, or one id."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPB1":
            raise ValueError("not a block of token ids")
        n, r, s = np.frombuffer(data, "<u4", 3, 4).tolist()
        at = 16
        parts = []
        for kind, k in (("<i8", n), ("u1", n), ("<u8", n), ("<u8", n), ("<u2", 2 * r), ("<u4", r), ("<u2", s)):
            parts.append(np.frombuffer(data, kind, k, at))
            at += parts[-1].nbytes
        self.doc_ids, self.missing, self.counts, self.begins, rules, lengths, self.symbols = parts
        self.flat, self.start, self.size = expansions(rules.reshape(-1, 2), lengths)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        total = np.cumsum(size)
        return self.flat[np.repeat(self.start[symbols] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]

    def _symbols(self, k: int) -> np.ndarray:
        end = self.begins[k + 1] if k + 1 < len(self.begins) else len(self.symbols)
        return self.symbols[int(self.begins[k]) : int(end)]

    def document(self, k: int) -> np.ndarray:
        return self._expand(self._symbols(k))

    def token(self, k: int, i: int) -> int:
        """Id i of document k: its symbol by the expansion lengths, then one expansion."""
        symbols = self._symbols(k)
        ends = np.cumsum(self.size[symbols])
        j = int(np.searchsorted(ends, i, "right"))
        return int(self.flat[self.start[symbols[j]] + i - (ends[j] - self.size[symbols[j]])])

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)


def pack(doc_ids: list[int | None], encoded: list[np.ndarray]) -> tuple[bytes, int]:
    """A block, and its number of symbols."""
    counts = np.array([len(x) for x in encoded], np.uint64)
    firsts = np.cumsum(counts).astype(np.int64) - counts.astype(np.int64)
    rules, lengths, symbols, begins = repair(np.concatenate(encoded), firsts)
    head = b"RPB1" + np.array([len(encoded), len(rules), len(symbols)], "<u4").tobytes()
    parts = (np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1"), counts, begins.astype("<u8"), rules, lengths.astype("<u4"), symbols)
    return head + b"".join(x.tobytes() for x in parts), len(symbols)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None, block: int = BLOCK, pieces: int = PIECES) -> DataFrame:
    """Files of all docs (doc_id, text) under path; returns the manifest, with the ids before each file."""
    if not 0 <= end_id < BASE:
        raise ValueError(f"end id {end_id} is not below {BASE}")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    shards = shards or shard_count(docs, size)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encode = encoder(tokenizer, pieces).encode
        end = np.array([end_id], np.uint16)
        done: list[dict] = []
        now: dict = {}
        doc_ids: list[int | None] = []
        encoded: list[np.ndarray] = []

        def flush() -> None:
            if encoded:
                data, symbols = pack(doc_ids, encoded)
                now["out"].write(len(data).to_bytes(8, "little") + data)
                now["row"]["documents"] += len(encoded)
                now["row"]["ids"] += sum(map(len, encoded))
                now["row"]["symbols"] += symbols
                now["row"]["bytes"] += len(data) + 8
                doc_ids.clear()
                encoded.clear()

        def close() -> None:
            flush()
            if now:
                now["out"].commit()
                done.append(now["row"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                shard, doc_id, text = (c.to_pylist() for c in batch.slice(at, 256).columns)
                for s, d, x in zip(shard, doc_id, encode(text), strict=True):
                    if not now or now["row"]["shard"] != s:
                        close()
                        name = f"ids-{s:06d}.rpb"
                        now.update(out=NewFile(path, name), row={"file": name, "shard": s, "documents": 0, "ids": 0, "symbols": 0, "bytes": 0, "base": 0})
                        size = 0
                    elif size >= block:
                        flush()
                        size = 0
                    doc_ids.append(d)
                    encoded.append(np.append(x, end))
                    size += len(x) + 1
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("shard", pa.int32()), *((k, pa.int64()) for k in ("documents", "ids", "symbols", "bytes", "base"))]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    files = commit_manifest(sharded(rows, "doc_id", shards, "text", cuts=cut_points(rows, "doc_id", shards, size)).select("shard", "doc_id", "text").mapInArrow(store, MANIFEST), path)
    # one row per file
    return files.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def blocks(stream) -> Iterator[Block]:
    while size := stream.read(8):
        yield Block(stream.read(int.from_bytes(size, "little")))


def read(spark: SparkSession, path: str, manifest: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, and its ids if wanted, from the files that the manifest names."""
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [])]
    schema = pa.schema(kinds)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_store(path)
        for batch in batches:
            for entry in batch.to_pylist():
                start, documents = entry["base"], 0
                with files.open_input_stream(f"{base}/{entry['file']}", compression=None) as stream:
                    for b in blocks(stream):
                        flat = b.ids().astype("<u4")
                        counts = b.counts.astype(np.int64)
                        ends = np.cumsum(counts)
                        data = memoryview(flat).cast("B")
                        sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                        columns = [pa.array(b.doc_ids, mask=b.missing.astype(bool)), pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())]
                        if ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)
                        start += int(ends[-1])
                        documents += len(counts)
                if documents != entry["documents"] or start - entry["base"] != entry["ids"]:
                    raise ValueError(f"{entry['file']} does not hold what the manifest says")

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return manifest.select("file", "documents", "ids", "base").repartition(shards, "file").mapInArrow(load, wanted)


def encode_and_read(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, ids: bool = False, pieces: int = PIECES) -> DataFrame:
    """Writes the files and reads them back."""
    return read(docs.sparkSession, path, write(docs, path, tokenizer, end_id, pieces=pieces), ids)
