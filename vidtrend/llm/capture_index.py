"""WARC archives with a two-level capture index.

Writing: pages become gzip members of WARC files in a shared folder, one file per task attempt under
a name of its own, so a repeated task never touches a file that another attempt's offsets name. Of
pages with equal payloads the one with the largest id is stored as response, the others as revisit.

Index: captures are range-partitioned and sorted by (reversed-host key, page id); each partition
writes a shard, its lines in compressed blocks of ``BLOCK_LINES`` followed by a directory with the
first key of every block. Level one is the list of shards (at most ``MAX_SHARDS``, one row each; only
this bounded list passes through the driver), level two the directory inside a shard.

Reading: a request is sent to its shard by binary search in the shard list, to its block by binary
search in the directory, and to its line by binary search in the block; the record is then fetched by
a range read. Requests are grouped by shard and records by file region, so neighbours share a read.

Files are opened through ``pyarrow.fs``: any folder URI that it knows and all executors share.

Scale: payloads stay with their scan; only digests are grouped (combined map-side). The table of
digests that occur twice is broadcast only if small, otherwise joined by shuffle, where a payload
that very many pages share is split by the skew rule.

Defined results: a null payload is empty; a null page id gives a record without id and never is the
one that others refer to; a null url has the key of an empty url. Repeated rows give repeated
records; those with the largest id are all responses. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.llm.common import shared_folder, slices, stored
from vidtrend.operators.scale import checked_broadcast

BLOCK_LINES = 1000
MAX_SHARDS = 4096
SHARD_LINES = 100_000
READ_GAP, READ_MOST = 1 << 16, 1 << 23
REGION = 1 << 24
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(uri: str):
    """File system and path of a folder URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then path and query; no scheme, user or fragment."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "%20")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(host == "", url).otherwise(key)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record as a gzip member."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
             f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> tuple:
    """Page id, payload bytes, digest, type and reference of a record; checks what it holds."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda text: int(text[10:-1]) if len(text) > 11 else None
    page, kind, digest = number(fields["WARC-Record-ID"]), fields["WARC-Type"], fields["WARC-Payload-Digest"][5:]
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != size:
            raise ValueError(f"record of page {page} is damaged")
    return page, size, digest, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None


def write_archives(pages: DataFrame, page_id: str, url: str, payload: str, min_bytes: int = 0,
                   date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, str]:
    """Write the archives; returns one capture per page (key, page_id, file, offset, length) and the folder."""
    folder = shared_folder(pages.sparkSession, "warc")
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body"))
    twice = (rows.filter(F.octet_length("body") >= min_bytes).groupBy("sha1")
             .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha1", "last"))
    refers = F.when((F.octet_length("body") >= min_bytes) & F.col("last").isNotNull()
                    & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    staged = rows.join(checked_broadcast(stored(twice, "payloads")), "sha1", "left").select(
        "page_id", "url", url_key(F.col("url")).alias("key"), "body", "sha1", refers.alias("refers_to"))

    def work(batches):
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        name, out, at = f"{path}/part-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in slices(batches, 64):
                found = []
                for row in batch.to_pylist():
                    out = out or files.open_output_stream(name, compression=None)
                    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                    member = record(row["page_id"], row["url"], row["body"], digest, row["refers_to"], date)
                    out.write(member)
                    found.append((row["key"], row["page_id"], name.rpartition("/")[2], at, len(member)))
                    at += len(member)
                yield _batch(found, CAPTURE)
        finally:
            if out:
                out.close()

    return stored(staged.mapInArrow(work, _ddl(CAPTURE)), "captures"), folder


CAPTURE = (("key", "string", pa.string()), ("page_id", "bigint", pa.int64()), ("file", "string", pa.string()),
           ("offset", "bigint", pa.int64()), ("length", "bigint", pa.int64()))
SHARD = (("first_key", "string", pa.string()), ("first_id", "bigint", pa.int64()), ("shard", "string", pa.string()),
         ("directory_at", "bigint", pa.int64()), ("directory_length", "bigint", pa.int64()), ("captures", "bigint", pa.int64()))
RESULT = (("page_id", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_digest", "string", pa.string()),
          ("record_type", "string", pa.string()), ("refers_to", "bigint", pa.int64()))


def _batch(rows, columns) -> pa.RecordBatch:
    values = list(zip(*rows)) if rows else [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, _, k) in zip(values, columns)], names=[c[0] for c in columns])


def _ddl(columns) -> str:
    return ", ".join(f"{n} {k}" for n, k, _ in columns)


def _order(page_id) -> int:
    return -(1 << 63) if page_id is None else page_id


def build_index(captures: DataFrame) -> tuple[DataFrame, str]:
    """Write the index; returns its shard list and its folder."""
    folder = shared_folder(captures.sparkSession, "index")
    shards = max(1, min(MAX_SHARDS, -(-captures.count() // SHARD_LINES)))

    def work(batches):
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        name, out, at, directory, lines, total = f"{path}/shard-{uuid.uuid4().hex}", None, 0, [], [], 0

        def flush():
            nonlocal at
            packed = zlib.compress(json.dumps(lines).encode(), 6)
            directory.append((lines[0][0], lines[0][1], at, len(packed)))
            out.write(packed)
            at += len(packed)
            lines.clear()

        try:
            for batch in slices(batches, 4096):
                for row in batch.to_pylist():
                    out = out or files.open_output_stream(name, compression=None)
                    lines.append((row["key"], _order(row["page_id"]), row["file"], row["offset"], row["length"]))
                    total += 1
                    if len(lines) == BLOCK_LINES:
                        flush()
            if lines:
                flush()
            if out:
                packed = zlib.compress(json.dumps(directory).encode(), 6)
                out.write(packed)
        finally:
            if out:
                out.close()
        if out:
            yield _batch([(directory[0][0], directory[0][1], name.rpartition("/")[2], at, len(packed), total)], SHARD)

    ordered = captures.repartitionByRange(shards, "key", "page_id").sortWithinPartitions("key", "page_id")
    return stored(ordered.mapInArrow(work, _ddl(SHARD)), "shards"), folder


def lookup(requests: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Captures of the requested ``key, page_id`` pairs, found through both levels of the index."""
    listed = sorted((r.first_key, r.first_id, r.shard, r.directory_at, r.directory_length) for r in shards.collect())
    firsts = [s[:2] for s in listed]

    def route(batches):
        for batch in slices(batches, 4096):
            rows = batch.to_pylist()
            places = [max(0, bisect_right(firsts, (r["key"], _order(r["page_id"]))) - 1) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), *batch.columns], names=["shard", *batch.schema.names])

    def find(batches):
        files, path = open_folder(folder)
        shard, source, directory, block, lines = None, None, [], None, []

        def load(number):
            nonlocal block, lines
            if block != number:
                at, length = directory[number][2:]
                source.seek(at)
                lines, block = json.loads(zlib.decompress(source.read(length))), number
            return lines

        for batch in slices(batches, 4096):
            found = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if source:
                        source.close()
                    shard, block = row["shard"], None
                    _, _, name, at, length = listed[shard]
                    source = files.open_input_file(f"{path}/{name}")
                    source.seek(at)
                    directory = json.loads(zlib.decompress(source.read(length)))
                    heads = [tuple(d[:2]) for d in directory]
                wanted = (row["key"], _order(row["page_id"]))
                for number in range(max(0, bisect_left(heads, wanted) - 1), len(heads)):
                    if heads[number] > wanted:
                        break
                    held = load(number)
                    for i in range(bisect_left(held, list(wanted)), len(held)):
                        if tuple(held[i][:2]) != wanted:
                            break
                        found.append((row["key"], row["page_id"], *held[i][2:]))
            yield _batch(found, CAPTURE)
        if source:
            source.close()

    routed = requests.select("key", "page_id").mapInArrow(route, "shard int, key string, page_id bigint")
    together = routed.repartition("shard").sortWithinPartitions("shard", "key", "page_id")
    return together.mapInArrow(find, _ddl(CAPTURE))


def read_records(found: DataFrame, folder: str) -> DataFrame:
    """Range-read the captures; ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    def work(batches):
        files, path = open_folder(folder)
        name, source = None, None
        for batch in slices(batches, 1024):
            rows, out, i = batch.to_pylist(), [], 0
            while i < len(rows):
                if rows[i]["file"] != name:
                    if source:
                        source.close()
                    name = rows[i]["file"]
                    source = files.open_input_file(f"{path}/{name}")
                start, end, last = rows[i]["offset"], rows[i]["offset"] + rows[i]["length"], i + 1
                while last < len(rows) and rows[last]["file"] == name and rows[last]["offset"] - end <= READ_GAP \
                        and rows[last]["offset"] + rows[last]["length"] - start <= READ_MOST:
                    end, last = rows[last]["offset"] + rows[last]["length"], last + 1
                source.seek(start)
                held = memoryview(source.read(end - start))
                for row in rows[i:last]:
                    low = row["offset"] - start
                    out.append(parse(held[low:low + row["length"]]))
                i = last
            yield _batch(out, RESULT)
        if source:
            source.close()

    near = found.withColumn("region", F.expr(f"offset div {REGION}")).repartition("file", "region")
    return near.sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(work, _ddl(RESULT))


SQL = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)
    FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM g
"""
