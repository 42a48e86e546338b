"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id; each shard rolls its files by compressed size; every record is a gzip member of its own with
regenerated headers and digests.  Files are written under temporary names and moved, and a manifest names those that count.  The
same rows give the same bytes, whichever executor writes them and however often.

Of the pages with equal payloads of at least ``least`` bytes, that with the largest page_id is a response and the others revisit
it; rows that repeat that page_id are responses too.  A null html is an empty payload, a null url a urn of the page, and a
url that a header can't hold as it is comes back exactly all the same; a null
page_id sorts first and counts as smaller than all.  Payloads are written whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shards import NewFile, commit_manifest, cut_points, open_store, shard_count, sharded

#: A file is closed at this many compressed bytes; records carry this date, so that bytes don't depend on the clock.
ROLL_BYTES, DATE = 64 << 20, "2000-01-01T00:00:00Z"
MANIFEST = "file string, shard int, part int, records long, bytes long, sha1 string"
RECORDS = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "".join([f"{first}\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + z.compress(data) + z.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url)


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit, which needs no payload but its size and digest."""
    http = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)])
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url, page_id)), ("X-Page-ID", page_id), ("X-URL", None if url is None else json.dumps(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None), ("WARC-Refers-To", _id(refers_to, digest) if revisit else None), ("X-Refers-To-Page-ID", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return _header("WARC/1.1", fields) + block + b"\r\n\r\n"


def numbered(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, size, digest) for each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another.

    Only digests take part, and only those that occur more than once are joined, one row for each; a payload with very many
    pages is split by AQE.
    """
    thin = rows.where(F.col("size") >= least).select("page_id", "digest")
    copies = thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "refers_to")
    found = thin.join(copies, F.col("digest") == F.col("_digest")).where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES, least: int = 0) -> DataFrame:
    """Archives of all pages (page_id, url, html) under path; returns the manifest."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    shards = shards or shard_count(pages, size)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        state: dict = {}

        def close() -> None:
            if state:
                state["out"].commit()
                done.append({"file": state["file"], "shard": state["shard"], "part": state["part"], "records": state["records"], "bytes": state["bytes"], "sha1": state["sha1"].hexdigest()})

        def put(data: bytes) -> None:
            state["out"].write(data)
            state["sha1"].update(data)
            state["bytes"] += len(data)

        def start(shard: int, part: int) -> None:
            close()
            name = f"pages-{shard:06d}-{part:05d}.warc.gz"
            state.update(out=NewFile(path, name), file=name, shard=shard, part=part, records=0, bytes=0, sha1=hashlib.sha1())
            info = b"software: deterministic sharded writer\r\nformat: WARC File Format 1.1\r\n"
            put(_member(_header("WARC/1.1", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n"))

        mark: tuple = ()
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                shard, page_id, digest, payload, url, size, refers_to = (c[i].as_py() for c in columns)
                if payload is None:
                    mark = (page_id, digest, refers_to)
                    continue
                if not state or state["shard"] != shard:
                    start(shard, 0)
                elif state["bytes"] >= roll_bytes:
                    start(shard, state["part"] + 1)
                revisit = mark[:2] == (page_id, digest)
                put(_member(record(page_id, url, payload, size, _base32(bytes.fromhex(digest)), mark[2] if revisit else None, revisit)))
                state["records"] += 1
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    rows = numbered(pages)
    # a revisit's mark sorts before its page, so that payloads are shuffled once
    marks = revisits(rows, least).select("page_id", "digest", F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("string").alias("url"), F.lit(0).cast("long").alias("size"), "refers_to")
    both = marks.unionByName(rows.withColumn("refers_to", F.lit(None).cast("long")))
    dealt = sharded(both, "page_id", shards, F.col("digest"), F.col("payload").isNotNull(), F.col("url"), cuts=cut_points(pages, "page_id", shards, size))
    return commit_manifest(dealt.select("shard", "page_id", "digest", "payload", "url", "size", "refers_to").mapInArrow(archive, MANIFEST), path)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Each gzip member of a stream, decompressed."""
    rest = b""
    z, parts = zlib.decompressobj(31), []
    while True:
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                break
        parts.append(z.decompress(rest))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> dict | None:
    """A record's page, its digest checked; None for other records."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and _base32(hashlib.sha1(payload).digest()) != digest or f"sha1:{_base32(hashlib.sha1(block).digest())}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"digests of {fields['WARC-Record-ID']} don't match")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": json.loads(fields["X-URL"]) if "X-URL" in fields else None, "html": payload.decode() if kind == "response" else None,
        "payload_bytes": len(payload) if kind == "response" else int(_fields(http)["Content-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"),
    }


def read(spark: SparkSession, path: str, html: bool = True) -> DataFrame:
    """The records of the archives that the manifest names; each file is read as a stream and checked against it."""
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest.json")
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([k for k in kinds if html or k[0] != "html"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(path)
        for batch in batches:
            for entry in batch.to_pylist():
                rows, size, n = [], 0, 0
                with store.open_input_stream(f"{base}/{entry['file']}", compression=None) as stream:
                    for data in members(stream):
                        if (row := parse(data)) is None:
                            continue
                        n += 1
                        rows.append(row)
                        size += len(data)
                        if size > 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if n != entry["records"]:
                    raise ValueError(f"{entry['file']} has {n} records; the manifest says {entry['records']}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = RECORDS if html else RECORDS.replace("html string, ", "")
    return manifest.select("file", "records").repartition(shards, "file").mapInArrow(load, wanted)
