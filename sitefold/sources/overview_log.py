"""Crawl logs on disk: Parquet partitioned by session, tab-separated files, or a database over JDBC."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.overview import SCHEMA, new_rows

FORMATS = ("parquet", "csv", "sqlite", "duckdb", "jdbc")
#: What a log file is called, by storage, in order of precedence.
_FILES = (("duckdb", "overview_urls.duckdb"), ("sqlite", "overview_urls.db"), ("csv", "overview_urls.tsv"))


def existing_backend(folder: str) -> str | None:
    """The storage of a log that lies in a folder already."""
    return next((b for b, f in _FILES if (Path(folder) / f).exists()), None)


def duckdb_available() -> bool:
    try:
        import duckdb  # noqa: F401
    except ImportError:
        return False
    return True


def resolve_backend(folder: str, override: str | None = None, use_database: bool = True) -> str:
    """The storage to use: what is asked for, what is there, csv without a database, else duckdb if it is installed, else sqlite."""
    if override:
        name = {"tsv": "csv"}.get(override.strip().lower(), override.strip().lower())
        if name not in ("csv", "sqlite", "duckdb"):
            raise ValueError(f"unknown storage {override!r}")
        return name
    return existing_backend(folder) or ("csv" if not use_database else "duckdb" if duckdb_available() else "sqlite")


def create_log(spark: SparkSession, table: str, path: str | None = None) -> None:
    """The log as a table, partitioned by session; partitions and Parquet statistics stand in for indexes."""
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({SCHEMA}) USING parquet PARTITIONED BY (session_date){where}")


def read_log(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A log's rows. Tab-separated ones have a header; a broken line is an error."""
    if fmt == "csv":
        return spark.read.schema(SCHEMA).option("header", True).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").option("enforceSchema", True).option("nullValue", "None").csv(path)
    if fmt in ("sqlite", "duckdb", "jdbc"):
        return spark.read.format("jdbc").options(url=path if path.startswith("jdbc:") else f"jdbc:{fmt}:{path}", dbtable="Overview", **options).load()
    return spark.read.schema(SCHEMA).parquet(path)


def append_log(rows: DataFrame, path: str, fmt: str = "parquet", once: bool = False, **options: str) -> None:
    """Adds rows; with once only those whose (domain, url, session_date, status) the log lacks."""
    spark = rows.sparkSession
    if once:
        try:
            old = read_log(spark, path, fmt, **options)
            old.schema  # noqa: B018 - resolves the path
            there = True
        except Exception as e:  # no log yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = False
        rows = new_rows(rows, old) if there else rows.dropDuplicates(["domain", "url", "session_date", "status"])
    rows = rows.select("domain", "identifier", "level", "url", "status", "session_date", "crawl_date", "path")
    if fmt == "csv":
        rows.write.mode("append").option("header", True).option("sep", "\t").option("quote", "").option("nullValue", "None").csv(path)
    elif fmt == "parquet":
        rows.repartition("session_date").write.mode("append").partitionBy("session_date").parquet(path)
    else:
        rows.write.mode("append").format("jdbc").options(url=path if path.startswith("jdbc:") else f"jdbc:{fmt}:{path}", dbtable="Overview", **options).save()


def delete_sessions(spark: SparkSession, path: str, start: str, end: str) -> list[str]:
    """Deletes the yyyy-MM-dd folders (session_date=... ones too) below path from start to end; their names."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(root) if fs.exists(root) else []:
        name = s.getPath().getName()
        date = name.removeprefix("session_date=")
        if s.isDirectory() and len(date) == 10 and date[4] == date[7] == "-" and date.replace("-", "").isdigit() and start <= date <= end:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def observed(rows: DataFrame, name: str = "crawl"):
    """rows, and an observation that holds pages and errors once they have been written."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("pages"), F.count(F.when(F.col("status") != "200", 1)).alias("errors")), seen
