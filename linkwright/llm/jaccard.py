"""Exact n-gram Jaccard join: components of documents whose shingle sets are at least ``percent`` alike.

1. Each task hashes the shingles of its documents and sends them, packed, to buckets of the hash space.  A bucket sees every
   occurrence of its shingles, so it knows their document frequency; it answers each batch of documents with the frequencies of
   the shingles that other documents have too, and the number of those that nobody else has.
2. Rare first: a document's shingles are ordered by frequency, those of its own first.  If its prefix holds only its own, it links
   with nothing.  The others keep their shared shingles, and equal sets go on as one.
3. Prefix index: candidates share a prefix shingle and pass the length filter, the positional filter, and a suffix filter (shared
   shingles counted by eight ranges of the hash space bound the overlap).
4. Each list of the index is first joined with one leader.  Lists whose members are then in one component are done, so that a
   group of near copies costs a row per member.  Pairs of different components remain: short lists are joined with themselves,
   long ones go through in blocks, whose overlaps are counted by a matrix product and which return a spanning forest of links.
   Every candidate pair is verified once, or known to be in one component.

A word is a run outside ``\\x20\\x09-\\x0D``, A-Z lower-cased.  A text with fewer words than a shingle has is one shingle; null
texts, and texts without words, have none and link with nothing.  Texts are taken whole.  Repeated rows are copies of each other.
A null doc_id counts as larger than all.  Columns besides doc_id and text are ignored.

Shingles are 64 bits, of which a bucket's number and the low 48 are kept; two sets are one if 128 bits agree.  Rows must come in
the same order when a task is repeated, as they do from a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, give_back, saved, thrifty
from .wordhash import mix, shingle_sets

#: Shingles that a task packs at once; members above which a list goes through in blocks; members of a block.
CHUNK, LONG, BLOCK = 1 << 19, 128, 512
LOW = np.uint64((1 << 48) - 1)
PACKED = "chunk long, bucket int, kind int, docs binary, tokens binary"
SETS = "doc_id long, n_shingles int, key long, key2 long, own int, prefix array<long>, ranges array<int>, tokens binary"


def needed(n, percent: int):
    """The overlap without which a set of n links with nothing; for numbers, arrays and columns of integers."""
    return -((-percent * n) // 100)


def _bits(buckets: int) -> int:
    return max(1, min(16, (buckets - 1).bit_length()))


def _batch(columns: list, kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))


_PACKED = [("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("tokens", pa.binary())]
_SETS = [("doc_id", pa.int64()), ("n_shingles", pa.int32()), ("key", pa.int64()), ("key2", pa.int64()), ("own", pa.int32()), ("prefix", pa.list_(pa.int64())), ("ranges", pa.list_(pa.int32())), ("tokens", pa.binary())]


def _pack(k: int, bits: int):
    """Packs the shingles of a task's documents by bucket; a chunk's list of documents (kind 0) takes the way of a bucket too."""

    def emit(chunk: int, ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(x) for x in sets], np.int64)
        tokens = np.concatenate(sets)
        ordinal = np.repeat(np.arange(len(sets)), n)
        bucket = (tokens >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        low = np.ascontiguousarray(tokens[order]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        ends = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        ordinal = ordinal[order]
        keys = [(np.add.reduce(mix(x)), np.add.reduce(mix(x ^ LOW))) for x in sets]
        about = np.zeros(len(sets), [("id", "<i8"), ("null", "u1"), ("n", "<i4"), ("key", "<u8"), ("key2", "<u8")])
        about["id"], about["null"], about["n"] = [x or 0 for x in ids], [x is None for x in ids], n
        about["key"], about["key2"] = [a for a, _ in keys], [b for _, b in keys]
        rows = [(chunk, chunk % (1 << bits), 0, about.tobytes(), b"")]
        for b in range(1 << bits):
            at, end = ends[b], ends[b + 1]
            if end > at:
                rows.append((chunk, b, 1, np.bincount(ordinal[at:end], minlength=len(sets)).astype("<u4").tobytes(), low[at:end].tobytes()))
        return _batch(list(zip(*rows, strict=True)), _PACKED)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, sets, size = [], [], 0
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                ids.append(doc_id)
                sets.append(x)
                size += len(x)
                if size >= CHUNK:
                    yield emit(chunk, ids, sets)
                    chunk += 1
                    ids, sets, size = [], [], 0
        if ids:
            yield emit(chunk, ids, sets)
        ids, sets = [], []
        give_back()

    return pack


def _count(bits: int):
    """A bucket's answers: for each chunk the unshared shingles of each document, and its shared ones with their frequency."""

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(r["chunk"], r["bucket"], 0, r["docs"], b"") for r in rows if r["kind"] == 0]
        rows = [r for r in rows if r["kind"] == 1]
        if rows:
            raw = np.frombuffer(b"".join(r["tokens"] for r in rows), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            low = wide.view("<u8").ravel()
            order = np.argsort(low)
            ordered = low[order]
            new = np.append(True, ordered[1:] != ordered[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(ordered)))
            frequency = np.empty(len(low), np.uint16)
            frequency[order] = np.repeat(np.minimum(times, 65_535), times)
            at = 0
            for r in rows:
                counts = np.frombuffer(r["docs"], "<u4").astype(np.int64)
                end = at + int(counts.sum())
                shared = frequency[at:end] > 1
                mine = np.bincount(np.repeat(np.arange(len(counts)), counts)[shared], minlength=len(counts))
                out.append((r["chunk"], r["bucket"], 1, np.stack([counts - mine, mine]).astype("<u4").tobytes(), raw[at:end][shared].tobytes() + frequency[at:end][shared].tobytes()))
                at = end
        return pa.Table.from_batches([_batch(list(zip(*out, strict=True)), _PACKED)])

    return thrifty(count)


def _order(bits: int, percent: int):
    """A chunk's documents with their prefixes, rarest shingles first."""

    def order(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        about = np.frombuffer(next(r["docs"] for r in rows if r["kind"] == 0), [("id", "<i8"), ("null", "u1"), ("n", "<i4"), ("key", "<u8"), ("key2", "<u8")])
        size = len(about)
        own, tokens, frequency, ordinal = np.zeros(size, np.int64), [], [], []
        for r in rows:
            if r["kind"] == 1:
                alone, mine = np.frombuffer(r["docs"], "<u4").reshape(2, -1).astype(np.int64)
                own += alone
                m = int(mine.sum())
                wide = np.zeros((m, 8), np.uint8)
                wide[:, :6] = np.frombuffer(r["tokens"], np.uint8, 6 * m).reshape(-1, 6)
                tokens.append(wide.view("<u8").ravel() | np.uint64(r["bucket"] << (64 - bits)))
                frequency.append(np.frombuffer(r["tokens"], "<u2", m, 6 * m))
                ordinal.append(np.repeat(np.arange(size), mine))
        n = about["n"].astype(np.int64)
        length = n - needed(n, percent) + 1
        wanted = (n > 0) & (own < length)
        prefix, ranges, blobs = [None] * size, [None] * size, [None] * size
        if tokens and wanted.any():
            ordinal = np.concatenate(ordinal)
            stay = wanted[ordinal]
            ordinal, tokens, frequency = ordinal[stay], np.concatenate(tokens)[stay], np.concatenate(frequency)[stay]
            by = np.lexsort((tokens, frequency, ordinal))
            ordinal, tokens = ordinal[by], tokens[by]
            ends = np.searchsorted(ordinal, np.arange(size + 1))
            for i in np.flatnonzero(wanted).tolist():
                x = tokens[ends[i] : ends[i + 1]]
                prefix[i] = x[: length[i] - own[i]].view(np.int64).tolist()
                ranges[i] = np.bincount((x & np.uint64(7)).astype(np.int64), minlength=8).tolist()
                blobs[i] = np.sort(x).tobytes()
        ids = [None if missing else i for i, missing in zip(about["id"].tolist(), about["null"].tolist(), strict=True)]
        return pa.Table.from_batches([_batch([ids, about["n"], about["key"].view(np.int64), about["key2"].view(np.int64), own, prefix, ranges, blobs], _SETS)])

    return thrifty(order)


def shared_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """For each document the size and key of its set; for those that may link, their prefix and shared shingles too."""
    # twice as many buckets as partitions: a bucket is held in memory as a whole
    bits = _bits(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).mapInArrow(_pack(k, bits), PACKED)
    counted = packed.groupBy("bucket").applyInArrow(_count(bits), PACKED)
    return counted.groupBy("chunk").applyInArrow(_order(bits, percent), SETS)


def _overlap_needed(n, m, percent: int):
    """Columns: the overlap that sets of n and m link with."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _candidate(percent: int, a: str, b: str):
    """Length, positional and suffix filters for two rows of the index."""
    n, m, p, q = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    wanted = _overlap_needed(n, m, percent)
    bound = F.aggregate(F.zip_with(f"{a}.ranges", f"{b}.ranges", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - p, m - q) >= wanted) & (bound >= wanted)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys that link."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n"), F.col("tokens").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                found[i] = 100 * common >= percent * (n[i] + m[i] - common)
            yield batch.select(["a", "b"]).filter(pa.array(found))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(verify, "a long, b long")


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a graph given as a symmetric matrix."""
    todo, out = np.ones(len(link), bool), []
    for root in range(len(link)):
        if todo[root]:
            todo[root] = False
            front = [root]
            while front:
                at = front.pop()
                new = np.flatnonzero(link[at] & todo)
                todo[new] = False
                out.extend((at, int(i)) for i in new)
                front.extend(new.tolist())
    return out


def _block_links(percent: int):
    """Links between the members of a block, or of two, that are in different components."""
    kinds = [("a", pa.int64()), ("b", pa.int64())]

    def block(table: pa.Table) -> pa.Table:
        n, component, key = (table.column(c).to_numpy() for c in ("n", "component", "key"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        size = np.array([len(x) for x in sets])
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        number = np.cumsum(times > 1) - 1
        stay = times[token] > 1
        row, column = row[stay], number[token[stay]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            at, end = np.searchsorted(column, (first, first + 2048))
            part = np.zeros((len(sets), 2048), np.float32)
            part[row[at:end], column[at:end] - first] = 1
            common += part @ part.T
        link = 100 * common >= percent * (n[:, None] + n - common)
        link &= component[:, None] != component
        edges = _forest(link)
        return pa.Table.from_batches([_batch([[int(key[i]) for i, _ in edges], [int(key[j]) for _, j in edges]], kinds)])

    return block


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of keys with the same components as all links between sets (key, n, own, prefix, ranges, tokens)."""
    index = saved(sets.select(F.posexplode("prefix").alias("i", "token"), "key", "n", (F.col("own") + F.col("i")).alias("pos"), "ranges").drop("i"), "index")
    lists = index.groupBy("token").agg(F.min("key").alias("key"), F.count("*").alias("members")).where("members > 1")
    leaders = index.join(lists, ["token", "key"])
    pairs = index.alias("y").join(leaders.alias("x"), (F.col("x.token") == F.col("y.token")) & (F.col("x.key") != F.col("y.key")) & _candidate(percent, "x", "y"))
    star = saved(_links(pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct(), sets, percent), "links")
    groups = components(star)
    where = index.join(lists.select("token", F.col("key").alias("leader"), "members"), "token").where("key <> leader").join(groups.withColumnRenamed("node", "key"), "key", "left")
    where = saved(where.withColumn("component", F.coalesce("component", "key")), "places")
    open_lists = where.groupBy("token").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).where("_least <> _most").select("token")
    rest = where.join(open_lists, "token")
    short = rest.where(F.col("members") <= LONG)
    pairs = short.alias("x").join(short.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & _candidate(percent, "x", "y"))
    out = star.unionByName(_links(pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct(), sets, percent))
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    long = rest.where(F.col("members") > LONG).withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    dealt = long.select("token", "key", "component", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "component")
    return out.unionByName(dealt.join(sets.select("key", "n", "tokens"), "key").groupBy("token", "i", "j").applyInArrow(_block_links(percent), "a long, b long"))


def near_copies(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs; component_id is the least doc_id reachable by links."""
    all_sets = saved(shared_sets(docs, k, percent), "sets")
    linked = all_sets.where("prefix is not null")
    classes = linked.groupBy("key", "key2").agg(F.min("doc_id").alias("first"))
    firsts = linked.join(classes.withColumnsRenamed({"key": "_key", "key2": "_key2"}), (F.col("key") == F.col("_key")) & (F.col("key2") == F.col("_key2")) & F.col("doc_id").eqNullSafe(F.col("first")))
    sets = saved(firsts.select("key", "key2", "doc_id", F.col("n_shingles").alias("n"), "own", "prefix", "ranges", "tokens").dropDuplicates(["key", "key2"]), "classes")
    groups = components(links(sets, percent))
    joined = sets.select("key", "key2", "doc_id").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = saved(joined.join(least, "component").select("key", "key2", "component_id"), "components")
    alone = all_sets.where("prefix is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.join(ids, ["key", "key2"]).select("doc_id", "n_shingles", "component_id")
    return alone.unionByName(out).withColumn("n_shingles", F.col("n_shingles").cast("long"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their own columns, that are first in their component by doc_id (nulls last) and hash of row.

    A row is known by its doc_id and text together, so that other texts under a repeated or null doc_id stand for themselves; of
    rows equal in both, one stays.
    """
    key = F.xxhash64("doc_id", "text")
    found = near_copies(docs.select(key.alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_component"))
    found = saved(found.where("_key is not null").distinct(), "rows")
    # only what has a component of several keys can go
    several = found.groupBy("_component").count().where("count > 1").select("_component")
    linked = found.join(several, "_component")
    known = docs.select(key.alias("_key"), "doc_id").distinct().join(linked, "_key")
    place = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col("_key").alias("key"))
    first = known.groupBy("_component").agg(F.min(place)["key"].alias("_first"))
    gone = saved(linked.join(first, "_component").where("_key <> _first").select("_key"), "gone")
    keyed = docs.withColumn("_key", key)
    kept = keyed.join(gone, "_key", "left_anti")
    repeated = kept.groupBy("_key").count().where("count > 1").select("_key")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    twice = kept.join(repeated, "_key", "left_semi")
    return kept.join(repeated, "_key", "left_anti").unionByName(twice.dropDuplicates(["_key"])).select(*docs.columns)
