"""The crawl log: one row a fetched page.

Columns: domain, identifier, level, url, status, session_date (yyyy-MM-dd), crawl_date, path; and ord, where order counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domains import SuffixRules, registered_domain
from ..functions.statuses import status_is_not_found, status_is_success
from ..functions.urls import clean_url

KEY = ("domain", "url", "session_date", "status")
SCHEMA = "domain string, identifier string, level int, url string, status string, session_date string, crawl_date string, path string"


def rows(fetched: DataFrame, rules: SuffixRules | None = None, *keep: str, domain: str | None = None) -> DataFrame:
    """Log rows of fetched pages (identifier, level, url, status, session_date, crawl_date, path), and columns to keep: the domain
    is that of the URL, which a column may hold already, or the URL itself for other schemes."""
    other = F.substring("url", 1, 6).contains(":") & ~F.col("url").startswith("http")
    return fetched.select(F.when(other, F.col("url")).otherwise(F.col(domain) if domain else registered_domain("url", rules)).alias("domain"), "identifier", F.col("level").cast("int").alias("level"), "url", F.col("status").cast("string").alias("status"), "session_date", "crawl_date", "path", *keep)


def success_window(log: DataFrame, start: str = "0000-01-01", end: str = "9999-01-01") -> DataFrame:
    """Successful rows of the sessions from start to end, both included. Dates compare as text, so a table that is
    partitioned by session_date is pruned."""
    return log.where((F.col("session_date") >= start) & (F.col("session_date") <= end) & (F.col("status") == "200"))


def recent_successes(log: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Clean URLs of seeds that succeeded after today - days."""
    since = F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")
    return log.where((F.col("level") == 0) & (F.col("session_date") > since) & (F.col("status") == "200")).select(clean_url("url").alias("key")).distinct()


def skip_recent(seeds: DataFrame, log: DataFrame, today: str, days: int = 30, url: str = "url") -> DataFrame:
    """Seeds that haven't succeeded lately."""
    done = recent_successes(log, today, days).withColumnRenamed("key", "_key")
    return seeds.join(done, clean_url(url) == F.col("_key"), "left_anti")


def complement(log: DataFrame, session_date: str) -> DataFrame:
    """url, identifier of the seeds of a session that failed in a way that a retry may mend, and never succeeded in it. Of
    several forms of a URL the first logged one is taken; blank statuses don't count."""
    seen = log.where((F.col("level") == 0) & (F.col("session_date") == session_date) & (F.trim(F.coalesce("status", F.lit(""))) != ""))
    ok = status_is_success("status")
    folded = seen.groupBy(clean_url("url").alias("key")).agg(
        F.bool_or(ok).alias("done"), F.bool_or(~ok & ~status_is_not_found("status")).alias("retry"), F.min_by(F.struct("url", "identifier"), "ord").alias("first")
    )
    return folded.where(~F.col("done") & F.col("retry")).select("first.url", "first.identifier")


def deduplicated(log: DataFrame, order: Column | str = "ord") -> DataFrame:
    """One row of each (domain, url, session_date, status), the first."""
    first = Window.partitionBy(*KEY).orderBy(F.col(order) if isinstance(order, str) else order)
    return log.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def new_rows(batch: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of batch whose key the target lacks, each key once: what an idempotent append adds."""
    mine = deduplicated(batch) if "ord" in batch.columns else batch.dropDuplicates(list(KEY))
    there = target.select(*(F.col(c).alias(f"_{c}") for c in KEY))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    return mine.join(there, same[0] & same[1] & same[2] & same[3], "left_anti")
