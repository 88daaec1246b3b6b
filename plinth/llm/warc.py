"""WARC archives that are indexed as they are written, and read back by byte ranges.

Writing: each task appends gzip members, one per record, to an archive of its
own in the shared folder and returns offset, length, URL and digest of each.
The kept index names only archives of tasks that succeeded, so a lost executor
costs a rewrite of its archives and leaves no wrong entry.

Reading: the selected index rows are sorted by archive and offset, neighbours
with small gaps become one ranged read, and only those bytes are fetched.

Of records with equal payloads of at least ``least_revisit`` bytes the one
with the largest key is a response and the others revisit it (repeated rows
with that key are responses each). Null payloads are empty; null keys and URLs
stay null; control characters of a URL are percent-encoded in the archive.
Other columns are not carried.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plinth.llm.batches import through
from plinth.llm.keys import integer_key
from plinth.llm.scratch import Scratch

LEAST_REVISIT = 1000
MAX_GAP, MAX_READ = 64 << 10, 8 << 20
#: Archive bytes (compressed) that one reading task fetches.
READ_TASK = 16 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "key bigint, path string, offset bigint, length bigint, url string, digest string, record_type string"
READ = "key bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def digest_header(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(key: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit has the digest and length of its payload, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key} {sha1_hex}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~')}")
    lines += [f"WARC-Payload-Digest: {digest_header(sha1_hex)}", f"X-Payload-Length: {len(payload)}"]
    if key is not None:
        lines.append(f"X-Key: {key}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {sha1_hex}')}>"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Key: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple:
    """key, url, type, refers_to, payload bytes, payload digest, payload. A response's figures are taken from its payload."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    h = dict(x.split(": ", 1) for x in lines)
    payload = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")[2]
    whole = lambda k: int(h[k]) if k in h else None
    url = unquote(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None
    if h["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size, digest, payload = int(h["X-Payload-Length"]), base64.b32decode(h["WARC-Payload-Digest"][5:]).hex(), None
    return whole("X-Key"), url, h["WARC-Type"], whole("X-Refers-To-Key"), size, digest, payload


def write_archives(pages: DataFrame, scratch: Scratch, key: str = "page_id", url: str = "url", payload: str = "html", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes all rows and returns the index."""
    body = F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8")
    rows = pages.select(integer_key(pages, key).alias("key"), F.col(f"`{url}`").alias("url"), body.alias("payload")).withColumns({"digest": F.sha1("payload"), "full": F.sha2("payload", 256)})
    copies = rows.where(F.octet_length("payload") >= least_revisit).groupBy("full").agg(F.max("key").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # only payloads that may be revisits travel by their digest; the others are written where they are read
    long = F.octet_length("payload") >= least_revisit
    dealt = rows.where(long).join(copies, "full", "left").unionByName(rows.where(~long).withColumn("keeper", F.lit(None).cast("bigint")))
    dealt = dealt.withColumn("revisit", F.col("keeper").isNotNull() & ~F.col("key").eqNullSafe(F.col("keeper")))
    root = f"{scratch.root}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(root)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for b in batches:
            entries = []
            for r in b.to_pylist():
                if out is None:
                    files.create_dir(folder, recursive=True)
                    out = files.open_output_stream(name, compression=None)
                member = record(r["key"], r["url"], r["payload"], r["digest"], r["keeper"], r["revisit"])
                out.write(member)
                entries.append({"key": r["key"], "path": name, "offset": at, "length": len(member), "url": r["url"], "digest": r["digest"], "record_type": "revisit" if r["revisit"] else "response"})
                at += len(member)
            yield pa.RecordBatch.from_pylist(entries, pa.schema([("key", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())]))
        if out is not None:
            out.close()

    return scratch.keep(through(dealt.select("key", "url", "payload", "digest", "keeper", "revisit"), run, INDEX), "index")


def coalesced(entries: list[tuple[str, int, int]], gap: int = MAX_GAP, most: int = MAX_READ) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (path, offset, length) as reads: path, start, size, and the (offset in the read, length) of its records."""
    run: list[tuple[str, int, int]] = []
    for e in entries:
        if run and (e[0] != run[0][0] or e[1] - (run[-1][1] + run[-1][2]) > gap or e[1] + e[2] - run[0][1] > most):
            yield run[0][0], run[0][1], run[-1][1] + run[-1][2] - run[0][1], [(o - run[0][1], n) for _, o, n in run]
            run = []
        run.append(e)
    if run:
        yield run[0][0], run[0][1], run[-1][1] + run[-1][2] - run[0][1], [(o - run[0][1], n) for _, o, n in run]


def read_archives(index: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records of these index rows, in parallel by ranges of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(root)
        schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        opened: tuple[str, object] = ("", None)
        for b in batches:
            entries = list(zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
            for path, start, size, parts in coalesced(entries):
                if opened[0] != path:
                    opened = (path, files.open_input_file(path))
                data = opened[1].read_at(size, start)
                found = [parse(data[o : o + n]) for o, n in parts]
                if not payloads:
                    found = [(*r[:-1], None) for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    # tasks by the bytes they will fetch, not by those of the index
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-size // READ_TASK))
    ordered = index.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(run, READ)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write, index and read back all pages."""
    scratch = Scratch(pages.sparkSession, "warc")
    index = write_archives(pages, scratch, key, url, payload)
    return read_archives(index, f"{scratch.root}/archives", payloads=False).withColumnRenamed("key", key)
