"""WARC files with a two-level capture index.

Captures are written as WARC/1.1 response records, each a gzip member of its own, by the task that holds them. Index
lines are sorted by reversed-host URL key (SURT: "org,example,www)/path?query"; scheme, fragment and letter case of the
host don't count) and kept in compressed blocks of BLOCK_LINES; a sparse directory has each block's first key. A look-up
finds the index file by binary search over the files' first keys (the only thing that is broadcast: one key a file), the
block by binary search in that file's directory, the lines by binary search in the block, and reads just the record's
byte range. Look-ups are sent to the task of their index file in key order, so that each block is read once.

Files get names that no other attempt uses, and only the rows of the attempt that succeeded point to them; so lost
executors and repeated tasks do no harm.

Defined results: pages without html are no captures and pages without url aren't looked up; an empty html is an empty
payload, a very long one is archived whole; several captures of a key are all returned, in any order, for each page that
asks; repeated rows are captures and look-ups each; a page_id that isn't a whole number counts as null; a URL without scheme
and host has the key ")" and itself; an empty table gives an empty index; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, filesystem, new_path

BLOCK_LINES = 500
FILE_BYTES = 1 << 30
LEVEL = 3


def surt(url: Column) -> Column:
    """The key of a URL."""
    parts = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)([^#]*)"
    host, rest = F.lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)
    return F.when(host == "", F.concat(F.lit(")"), url)).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(url: str, html: str, key: str) -> bytes:
    """A response record, compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode("utf-8", "surrogatepass")
    name = uuid.uuid5(uuid.NAMESPACE_URL, key)
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {target}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return _member(head.encode("utf-8", "surrogatepass") + http + b"\r\n\r\n")


def payload(member: bytes) -> bytes:
    """The html of a compressed record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return rest[:size].partition(b"\r\n\r\n")[2]


def write_archive(pages: DataFrame, path: str) -> DataFrame:
    """Writes WARC files below path; key, page_id, file, offset, length of every capture."""

    def write(batches):
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            for key, page, url, html in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or at >= FILE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = record(url, html, f"{page}:{url}")
                out.write(data)
                rows.append((key, page, name, at, len(data)))
                at += len(data)
            # rows leave only when their bytes are in the file
            if out:
                out.flush()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    held = pages.where("url is not null and html is not null").select(surt(F.col("url")).alias("key"), F.col("page_id").try_cast("long").alias("page_id"), "url", "html")
    return cut(held.mapInArrow(write, "key string, page_id long, file string, offset long, length long"))


def write_index(captures: DataFrame, path: str) -> DataFrame:
    """Writes sorted, compressed index blocks and their directory; first_key, file of every index file."""

    def blocks(batches):
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        name, at, directory, lines = f"{uuid.uuid4().hex}.cdx.gz", 0, [], []
        out = None

        def flush():
            nonlocal at, out
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            data = _member(json.dumps(lines).encode())
            directory.append((lines[0][0], at, len(data)))
            out.write(data)
            at += len(data)
            lines.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
                f.write(_member(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], names=["first_key", "file"])

    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key", "page_id", "file", "offset")
    return cut(ordered.mapInArrow(blocks, "first_key string, file string"))


def look_up(wanted: DataFrame, index: DataFrame, archive_path: str, index_path: str) -> DataFrame:
    """For each row of wanted (page_id, url, key) the captures of its key: page_id, url, url_key, capture_id, n_bytes, digest."""
    spark: SparkSession = wanted.sparkSession
    files = sorted((r["first_key"].encode(), r["file"]) for r in index.collect())  # one row an index file
    sent = spark.sparkContext.broadcast(files)
    schema = "page_id long, url string, url_key string, capture_id long, n_bytes long, digest string"
    if not files:
        return spark.createDataFrame([], schema)
    firsts = F.array(*(F.lit(k.decode()) for k, _ in files)) if len(files) <= 200 else None

    def route(batches):
        keys = [k for k, _ in sent.value]
        for b in batches:
            at = [max(0, bisect.bisect_right(keys, k.encode()) - 1) for k in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=["page_id", "url", "key", "f"])

    # equal keys are in one index file, because range partitioning never splits a key
    routed = wanted.select("page_id", "url", "key")
    if firsts is not None:
        routed = routed.withColumn("f", F.greatest(F.lit(0), F.size(F.filter(firsts, lambda x: x <= F.col("key"))) - 1).cast("int"))
    else:
        routed = routed.mapInArrow(route, "page_id long, url string, key string, f int")

    def search(batches):
        fs, archive = filesystem(archive_path)
        _, root = filesystem(index_path)
        opened: dict = {}
        file, directory, firsts, block, lines, keys, handle = -1, [], [], -1, [], [], None

        def read(path, offset, length):
            if path not in opened:
                if len(opened) > 64:
                    opened.popitem()[1].close()
                opened[path] = fs.open_input_file(path)
            return opened[path].read_at(length, offset)

        for b in batches:
            rows = []
            for page, url, key, f in zip(*(c.to_pylist() for c in b.columns)):
                raw = key.encode()
                if f != file:
                    file, block = f, -1
                    name = f"{root}/{sent.value[f][1]}"
                    with fs.open_input_stream(f"{name}.dir", compression=None) as d:
                        directory = json.loads(zlib.decompress(d.read(), 31))
                    firsts = [x[0].encode() for x in directory]
                k = max(0, bisect.bisect_left(firsts, raw) - 1)  # a key may begin in the block before
                while k < len(directory) and firsts[k] <= raw:
                    if k != block:
                        lines = json.loads(zlib.decompress(read(name, *directory[k][1:]), 31))
                        keys, block = [x[0].encode() for x in lines], k
                    for i in range(bisect.bisect_left(keys, raw), bisect.bisect_right(keys, raw)):
                        _, capture, warc, offset, length = lines[i]
                        html = payload(read(f"{archive}/{warc}", offset, length))
                        rows.append((page, url, key, capture, len(html), hashlib.md5(html).hexdigest()))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["page_id", "url", "url_key", "capture_id", "n_bytes", "digest"])
        for h in opened.values():
            h.close()

    return routed.repartition("f").sortWithinPartitions("f", "key").mapInArrow(search, schema)


def archive_and_look_up(pages: DataFrame) -> DataFrame:
    """Archives all pages, indexes them, and looks every page's URL up."""
    spark = pages.sparkSession
    base = new_path(spark, "warc")
    index = write_index(write_archive(pages, f"{base}/warc"), f"{base}/cdx")
    wanted = pages.where("url is not null").select(F.col("page_id").try_cast("long").alias("page_id"), "url", surt(F.col("url")).alias("key"))
    return look_up(wanted, index, f"{base}/warc", f"{base}/cdx")


SQL = r"""
WITH p AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)([^#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)([^#]*)', 2) AS rest FROM pages WHERE url IS NOT NULL),
k AS (SELECT *, CASE WHEN host = '' THEN ')' || url ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS url_key FROM p)
SELECT a.page_id, a.url, a.url_key, b.page_id AS capture_id, CAST(octet_length(encode(b.html)) AS BIGINT) AS n_bytes, md5(b.html) AS digest FROM k a JOIN k b ON a.url_key = b.url_key AND b.html IS NOT NULL
"""
