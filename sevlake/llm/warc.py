"""Operator 1: WARC archives with a two-level capture index.

Archives hold a gzip member per record, so a record can be read by its range.
The index has two levels: captures sorted by reversed-host URL key are packed
into compressed blocks, and a sparse directory has a row per block.  A look-up
searches the directory by bisection, reads the range of one block, searches it
by bisection, and reads the ranges of the records.

Tasks write and read files in the shared folder through Arrow's file systems;
the name of a file holds the task attempt, so a repeated task leaves the files
of the lost one unused.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sevlake.llm.common import materialise, scratch, small_batches

REVISIT_BYTES = 1_000  # least payload that is replaced by a revisit
ARCHIVE_BYTES = 64 << 20
BLOCK_CAPTURES = 1_000
READ_AHEAD = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as executors have to open it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file:///") else "file://" + uri[5:])


def url_key(url: Column) -> Column:
    """Reversed-host key: ``http://a.example.com:80/p?q`` -> ``com,example,a:80)/p?q``, host in lower case, no
    scheme.  Null: empty; what has no host stays as it is.  Tabs and line ends become spaces."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?(.*)$"
    part = lambda n: F.regexp_extract(clean, pattern, n)
    clean = F.translate(F.coalesce(url, F.lit("")), "\t\r\n", "   ")
    host = F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ",")
    return F.when(part(1) != "", F.concat(host, part(2), F.lit(")"), part(3))).otherwise(clean)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))])]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=2, mtime=0)


def _digest(hexa: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexa)).decode()


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row and return the captures ``(key, id, file, offset,
    length)``.

    A null payload is empty, a null URL has the empty key.  Of rows with equal
    payloads (SHA-256) of at least ``revisit_bytes`` bytes, those with the
    largest id are responses and the others revisit it; a null id never is the
    largest unless all are null, and rows that tie are all responses.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    folder = qualified(spark, folder)
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body")).withColumns({"strong": F.sha2("body", 256), "big": F.octet_length("body") >= revisit_bytes})
    groups = rows.where("big").groupBy("strong").agg(F.max("id").alias("of"), F.count("strong").alias("n"))
    groups = materialise(groups.where("n > 1").select(F.col("strong").alias("shared"), "of"), "warc-equal")
    joined = rows.join(groups, F.col("big") & (F.col("strong") == F.col("shared")), "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("of")) & F.col("of").isNotNull(), F.col("of").cast("string"))
    ready = joined.select(F.col("id").cast("string").alias("id"), "url", url_key(F.col("url")).alias("key"), refers.alias("refers"), F.sha1("body").alias("sha1"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        task, number, out, at, name = TaskContext.get(), 0, None, 0, ""
        for b in batches:
            found = []
            for page, url, key, refers, sha1, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.gz"
                    out, at, number = fs.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                    head = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(head)
                    at = len(head)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                headers = [("WARC-Type", "revisit" if refers is not None else "response"), ("WARC-Record-ID", f"<{_ID}{page or ''}>"), ("WARC-Date", DATE), ("WARC-Payload-Digest", _digest(sha1)), ("Content-Type", "application/http; msgtype=response")]
                if url is not None:
                    headers.append(("WARC-Target-URI", _uri(url)))
                if refers is not None:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_ID}{refers}>")]
                made = _record(headers, http if refers is not None else http + body)
                out.write(made)
                found.append((key, page, name, at, len(made)))
                at += len(made)
            cols = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], ["key", "id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialise(ready.mapInArrow(run, "key string, id string, file string, offset bigint, length bigint"), "warc-captures")


def build_index(captures: DataFrame, folder: str, block_captures: int = BLOCK_CAPTURES) -> DataFrame:
    """Write the index: shards of sorted compressed blocks and, beside each, its
    sparse directory.  Returns ``(shard, first, last, blocks)``, a row per shard.
    A key with very many captures spans blocks and shards."""
    spark = captures.sparkSession
    folder = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        task, out, at, directory, block, last = TaskContext.get(), None, 0, [], [], None
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"

        def flush():
            nonlocal at, block
            data = zlib.compress("\n".join("\t".join(r) for r in block).encode("utf-8", "surrogatepass"), 3)
            out.write(data)
            directory.append((block[0][0], at, len(data)))
            at, block = at + len(data), []

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}.idx", compression=None)
                block.append((row[0], "" if row[1] is None else "=" + row[1], row[2], str(row[3]), str(row[4])))
                last = row[0]
                if len(block) >= block_captures:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
            f.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, directory[0][0], last, len(directory))], ["shard", "first", "last", "blocks"])

    order = ["key", "id", "file", "offset"]
    ordered = captures.select("key", "id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ordered.mapInArrow(run, "shard string, first string, last string, blocks bigint"), "warc-shards")


def look_up(shards: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """Captures ``(key, id, file, offset, length)`` of the distinct ``keys(key)``; keys without captures give none."""
    spark = keys.sparkSession
    folder = qualified(spark, folder)
    # a row per index partition
    ranges = sorted((r["first"].encode(), r["last"].encode(), r["shard"]) for r in shards.collect())
    firsts, lasts = [r[0] for r in ranges], [r[1] for r in ranges]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for key in b.column(0).to_pylist():
                k = key.encode()
                found += [(ranges[i][2], key) for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        shard, directory, file, held, rows, keys_held = None, [], None, -1, [], []
        for b in batches:
            found = []
            for name, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != shard:
                    with fs.open_input_stream(f"{root}/{name}.dir") as f:
                        directory = json.loads(f.read())
                    heads = [d[0].encode() for d in directory]
                    shard, file, held = name, fs.open_input_file(f"{root}/{name}.idx"), -1
                k = key.encode()
                at = max(0, bisect_left(heads, k) - 1)
                while at < len(heads) and (heads[at] <= k):
                    if held != at:
                        file.seek(directory[at][1])
                        rows = [x.split("\t") for x in zlib.decompress(file.read(directory[at][2])).decode("utf-8", "surrogatepass").split("\n")]
                        keys_held, held = [r[0].encode() for r in rows], at
                    found += rows[bisect_left(keys_held, k) : bisect_right(keys_held, k)]
                    at += 1
                if len(found) >= 20_000:
                    yield _captures(found)
                    found = []
            yield _captures(found)

    routed = keys.select("key").distinct().mapInArrow(route, "shard string, key string")
    dealt = routed.repartition("shard").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(search, "key string, id string, file string, offset bigint, length bigint")


def _captures(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in found], pa.string()), pa.array([r[1][1:] if r[1] else None for r in found], pa.string()), pa.array([r[2] for r in found], pa.string()),
         *(pa.array([int(r[i]) for r in found], pa.int64()) for i in (3, 4))], ["key", "id", "file", "offset", "length"])


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of a record."""
    raw = gzip.decompress(member)
    head, block = raw.split(b"\r\n\r\n", 1)
    fields = lambda x: {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in x.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = block[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def read_records(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Read the records of ``captures``: ``(id, key, url, record_type, payload_bytes, payload_digest, refers_to)``
    and, with ``with_payload``, ``payload`` (null for revisits).  A response whose payload doesn't match its
    digest raises.  A revisit's size is that of the HTTP header it keeps."""
    folder = qualified(captures.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name, file, held, at = None, None, b"", 0
        for b in batches:
            rows = []
            for key, page, path, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != name:
                    name, file, held, at = path, fs.open_input_file(f"{root}/{path}"), b"", 0
                if not at <= offset <= offset + length <= at + len(held):
                    file.seek(offset)
                    held, at = file.read(max(length, READ_AHEAD)), offset
                warc, http, payload = parse_record(held[offset - at : offset - at + length])
                kind = warc["warc-type"]
                sha1 = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(payload).hexdigest() != sha1:
                    raise ValueError(f"{path} at {offset}: the payload doesn't match its digest")
                refers = warc.get("warc-refers-to")
                rows.append((page, key, warc.get("warc-target-uri"), kind, int(http["content-length"]), sha1, refers and refers[1:-1].removeprefix(_ID), payload if with_payload and kind == "response" else None))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "key", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    dealt = captures.select("key", "id", "file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    out = dealt.mapInArrow(run, "id string, key string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")
    return out if with_payload else out.drop("payload")


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives and the index of ``pages`` to fresh shared folders, look every URL up, and read what
    is found: a row per row of ``pages``.  An empty table gives an empty table; other columns aren't read."""
    spark = pages.sparkSession
    archive, index = scratch(spark, "warc"), scratch(spark, "warc-index")
    captures = write_archives(pages, archive, id_col, url_col, payload_col)
    shards = build_index(captures, index)
    hits = look_up(shards, index, pages.select(url_key(F.col(url_col)).alias("key")))
    kind = pages.schema[id_col].dataType
    got = read_records(hits, archive)
    return got.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "key")
