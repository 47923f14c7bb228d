"""Crawl statuses, waits between requests, and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _col

CAP = 30.0
NOT_FOUND = ("website not found in __test_domain_robots", "website not found", "dns lookup failed")
RETRY_DELAYS = (0.0, 6.0, 18.0)
TOO_MANY_ERRORS = 20


def status_code(status: Column | str) -> Column:
    """The status as a number, null for phrases."""
    return F.trim(_col(status)).try_cast("double").try_cast("int")


def status_is_success(status: Column | str) -> Column:
    """Whether the whole part of the status is 200; null and blank ones aren't."""
    return F.coalesce(status_code(status) == 200, F.lit(False))


def status_is_not_found(status: Column | str, phrases: tuple[str, ...] = NOT_FOUND) -> Column:
    """Whether the site is gone for good, so that a retry makes no sense."""
    return F.coalesce(F.lower(F.trim(_col(status))).isin(*phrases), F.lit(False))


def exception_status(message: Column | str) -> Column:
    """The status phrase of a failed request's message."""
    m = F.lower(_col(message))
    return (
        F.when(m.contains("timed out"), "Request timeout")
        .when(m.contains("name or service not known") | m.contains("nodename nor servname"), "DNS lookup failed")
        .when(m.contains("cannot connect to host"), "Connection failed")
        .otherwise("Request failed")
    )


def next_wait(wait: Column, status: Column, retry_after: Column) -> Column:
    """Seconds to wait before the domain's next request: longer after refusals and failures, slowly shorter otherwise."""
    code, text = status_code(status), F.lower(status)
    trouble = text.contains("timeout") | text.contains("connection failed") | text.contains("request failed") | text.contains("dns lookup failed")
    longer = (
        F.when((code == 429) & retry_after.isNotNull(), F.greatest(retry_after, F.lit(0.0)))
        .when(code == 429, F.greatest(F.lit(6.0), wait * 2))
        .when(code == 403, F.greatest(F.lit(3.0), wait * 1.6 + 0.25))
        .when(code >= 500, F.greatest(F.lit(1.5), wait * 1.3 + 0.15))
        .when(F.coalesce(trouble, F.lit(False)), F.greatest(F.lit(1.5), wait * 1.2 + 0.1))
        .otherwise(wait * 0.85)
    )
    return F.least(F.lit(CAP), longer)


def wait_after(attempts: Column | str, start: float = 0.0) -> Column:
    """The wait after an array of (status, retry_after) structs, in order."""
    return F.aggregate(_col(attempts), F.lit(float(start)), lambda w, a: next_wait(w, a["status"], a["retry_after"]))


def initial_wait(level: Column | str, known: Column | str) -> Column:
    """The wait before a domain's first request: none for seeds and domains with a state."""
    return F.when((_col(level) == 0) | _col(known), 0.0).otherwise(0.35)


def retry_after_seconds(text: Column | str, now: Column | str | None = None) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date's distance from now, 0 if it has passed; else null."""
    t = F.trim(_col(text))
    now = F.current_timestamp() if now is None else _col(now)
    # the day's name isn't parsed, so a wrong one does no harm
    date = F.try_to_timestamp(F.regexp_extract(t, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    gap = F.when(date.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(date) - F.unix_micros(now.cast("timestamp"))) / 1e6))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("double")).otherwise(gap)


def iso_date(text: Column | str) -> Column:
    """A yyyy-MM-dd date, null if the text isn't one."""
    t = _col(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date"))
