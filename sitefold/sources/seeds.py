"""Seed lists: delimited files with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_source_url

URL_NAMES, ID_NAMES = ("url", "website", "domain"), ("identifier", "id")


def delimiter_of(header: str) -> str:
    return "\t" if "\t" in header else ","


def pick_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The column that has the first of the names, whatever its case and blanks."""
    tidy = {}
    for c in columns:
        tidy.setdefault(c.strip().lower(), c)
    return next((tidy[n] for n in names if n in tidy), None)


def deduplicated(seeds: DataFrame) -> DataFrame:
    """url, identifier, ord: of rows equal in URL and identifier the first."""
    return seeds.groupBy("url", "identifier").agg(F.min("ord").alias("ord"))


def read_source_urls(spark: SparkSession, path: str) -> DataFrame:
    """url, identifier, ord of a seed file. Where there is a level column just seeds count; an identifier "NULL" is none."""
    header = spark.read.text(path).limit(1).collect()
    sep = delimiter_of(header[0][0] if header else "")
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    url = pick_column(df.columns, URL_NAMES) or df.columns[0]
    ident, level = pick_column(df.columns, ID_NAMES), pick_column(df.columns, ("level",))
    if level:
        df = df.where(F.trim(F.coalesce(F.col(f"`{level}`"), F.lit(""))).isin("", "0"))
    i = F.trim(F.col(f"`{ident}`")) if ident else F.lit(None).cast("string")
    rows = df.select(F.monotonically_increasing_id().alias("ord"), normalize_source_url(F.col(f"`{url}`")).alias("url"), F.when((F.upper(i) != "NULL") & (i != ""), i).alias("identifier"))
    return deduplicated(rows.where("url is not null")).orderBy("ord")
