"""Crawl logs as streams: late and repeated rows, waits by domain, counts by window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.overview import SCHEMA, new_rows

KEY = ["domain", "url", "session_date", "status"]


def log_stream(spark: SparkSession, path: str, files_a_trigger: int | None = None) -> DataFrame:
    """New log rows below path, with crawl_ts."""
    reader = spark.readStream.schema(SCHEMA)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(path).withColumn("crawl_ts", F.try_to_timestamp("crawl_date", F.lit("yyyy-MM-dd HH:mm:ss")))


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each key once; keys are forgotten after the delay, so the state stays bounded."""
    return stream.withWatermark("crawl_ts", delay).dropDuplicatesWithinWatermark(KEY)


def status_counts(stream: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Pages by window and status."""
    return stream.withWatermark("crawl_ts", delay).groupBy(F.window("crawl_ts", window, slide or window), "status").agg(F.count("*").alias("pages"))


def waits(stream: DataFrame, idle_ms: int = 3_600_000, delay: str = "1 day") -> DataFrame:
    """domain, wait after each batch of rows (domain, crawl_ts, ord, status, retry_after). A domain that has been idle for so
    long by the log's own time is forgotten, so the state stays bounded."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        wait = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(["crawl_ts", "ord"])
        for status, after in zip(rows.status, rows.retry_after):
            wait = wait_step(wait, status, None if pd.isna(after) else float(after))
        state.update((wait,))
        last = rows.crawl_ts.max()
        now = 0 if pd.isna(last) else int(last.timestamp() * 1000)
        state.setTimeoutTimestamp(max(now, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"domain": [key[0]], "wait": [wait]})

    late = stream.withWatermark("crawl_ts", delay)
    return late.groupBy("domain").applyInPandasWithState(step, "domain string, wait double", "wait double", "update", GroupStateTimeout.EventTimeTimeout)


def wait_step(wait: float, status: str | None, retry_after: float | None) -> float:
    """functions.statuses.next_wait() for one row."""
    text = (status or "").strip()
    try:
        code = int(float(text))
    except (ValueError, OverflowError):
        code = 0
    low = text.lower()
    if code == 429:
        longer = max(retry_after, 0.0) if retry_after is not None else max(6.0, wait * 2)
    elif code == 403:
        longer = max(3.0, wait * 1.6 + 0.25)
    elif code >= 500:
        longer = max(1.5, wait * 1.3 + 0.15)
    elif any(p in low for p in ("timeout", "connection failed", "request failed", "dns lookup failed")):
        longer = max(1.5, wait * 1.2 + 0.1)
    else:
        longer = wait * 0.85
    return min(30.0, longer)


def append_once(stream: DataFrame, path: str, checkpoint: str):
    """A running query that adds to the Parquet log at path what it lacks: a batch that comes twice adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        from pyspark.errors import AnalysisException

        spark = batch.sparkSession
        rows = batch.select(*(c.split()[0] for c in SCHEMA.split(", ")))
        dates = [r[0] for r in rows.select("session_date").distinct().collect()]  # the batch's partitions
        try:
            old = spark.read.schema(SCHEMA).parquet(path).where(F.col("session_date").isin(dates))
        except AnalysisException:
            old = spark.createDataFrame([], SCHEMA)
        new_rows(rows, old).write.mode("append").partitionBy("session_date").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
