"""Page archives: one zip a host, compressed with LZMA."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write_archives(pages: DataFrame, path: str) -> int:
    """Writes pages (zip_name, member, content) as path/<zip_name>.zip; a host's archive is written by one task, page by page,
    first under another name, so that a repeated task replaces it. The number of archives."""

    def write(batches):
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        name = part = stream = archive = None
        done = 0

        def close():
            archive.close()
            stream.close()
            fs.move(part, f"{root}/{name}.zip")

        for b in batches:
            for n, m, c in zip(*(x.to_pylist() for x in b.columns)):
                if n != name:
                    if name is not None:
                        close()
                        done += 1
                    name, part = n, f"{root}/_{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(part, compression=None)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_LZMA)
                archive.writestr(m, c)
        if name is not None:
            close()
            done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["n"])

    rows = pages.select("zip_name", "member", F.col("content").cast("binary").alias("content")).repartition("zip_name").sortWithinPartitions("zip_name", "member")
    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """zip_name, member, content of every member of path/*.zip."""
    names = ["zip_name", "member", "content"]

    def members(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                zip_name, rows, size = p.rsplit("/", 1)[-1].removesuffix(".zip"), [], 0
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        rows.append((zip_name, info.filename, z.read(info)))
                        size += info.file_size
                        if size > 4_000_000 or len(rows) == 512:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInArrow(members, "zip_name string, member string, content binary")


def with_pages(log: DataFrame, archives: DataFrame) -> DataFrame:
    """Log rows with html, found by their path: .../crawled_data/<zip>/<member>; null where the archive has none. Bytes that
    aren't UTF-8 are left out."""
    at = F.regexp_extract("path", r"(?:^|/)crawled_data/([^/]+)/(.+)$", 1)
    member = F.regexp_extract("path", r"(?:^|/)crawled_data/([^/]+)/(.+)$", 2)

    @F.pandas_udf("string")
    def text(content):
        return content.map(lambda c: None if c is None else bytes(c).decode("utf-8", "ignore"))

    side = archives.select(F.col("zip_name").alias("_zip"), F.col("member").alias("_member"), "content")
    return log.join(side, (at == F.col("_zip")) & (member == F.col("_member")), "left").withColumn("html", text("content")).drop("_zip", "_member", "content")
