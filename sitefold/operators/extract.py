"""Page records from a page store: metadata, text, zip codes, addresses and plug-in fields.

Python only tokenizes; filters and column choice come before it, regular expressions after it in the JVM.
"""

from __future__ import annotations

import contextlib
import signal
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions.html import Page, parse

FAILED, TIMED_OUT = "Error extracting", "Timeout extracting"
PARTS = "html_text string, raw_text string, hrefs array<string>, meta map<string,string>, plugin map<string,array<string>>, error string"


@dataclass
class Fields:
    """Fields that records have besides the built-in ones. page: name to a function of a Page, run in the tokenizing pass;
    sql: name to a function that makes a column of the columns text, html, url and hrefs. A field named zipcode or address
    replaces the built-in one."""

    page: dict[str, Callable[[Page], list[str]]] = field(default_factory=dict)
    sql: dict[str, Callable[[dict[str, Column]], Column]] = field(default_factory=dict)

    def register_field(self, name: str, fn: Callable[[Page], list[str]]) -> None:
        self.page[name] = fn

    def register_sql_field(self, name: str, make: Callable[[dict[str, Column]], Column]) -> None:
        self.sql[name] = make


def contact_fields() -> Fields:
    """Phone, e-mail, fax, annual reports, registration and VAT numbers."""
    return Fields(
        sql={
            "phone": lambda c: X.phones(c["html"]), "email": lambda c: X.emails(c["html"]), "fax": lambda c: X.faxes(c["html"]), "kvk": lambda c: X.kvk_numbers(c["text"]),
            "btw": lambda c: X.vat_numbers(c["text"]), "annual_report": lambda c: X.report_links(c["hrefs"], c["url"]),
        }
    )


@contextlib.contextmanager
def _limited(seconds: float | None):
    """Raises TimeoutError after so many seconds, where this is the process's main thread, as it is in Spark's workers."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError

    old = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def tokenized(pages: DataFrame, plugins: dict[str, Callable[[Page], list[str]]], timeout: float | None = 10.0, url: str = "url", html: str = "html") -> DataFrame:
    """pages with the parts of each page. A page that fails or takes too long has an error and no parts; the others go on."""
    names = pages.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", " + PARTS
    at, body = names.index(url), names.index(html)

    def one(u, h):
        try:
            with _limited(timeout):
                if h is None:
                    return None, None, None, None, None, FAILED
                page = parse(h, u)
                extra = {k: list(f(page)) for k, f in sorted(plugins.items())}
                return page.text, page.raw_text, page.hrefs, page.meta, extra, None
        except TimeoutError:
            return None, None, None, None, None, TIMED_OUT
        except Exception:  # one bad page or plug-in mustn't end the job
            return None, None, None, None, None, FAILED

    kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.list_(pa.string())), pa.string())

    def run(batches):
        for b in batches:
            for a in range(0, max(b.num_rows, 1), 512):
                part = b.slice(a, 512)
                found = [one(u, h) for u, h in zip(part.column(at).to_pylist(), part.column(body).to_pylist())]
                new = [pa.array([list(x[k].items()) if isinstance(x[k], dict) else x[k] for x in found], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, "html_text", "raw_text", "hrefs", "meta", "plugin", "error"])

    return pages.mapInArrow(run, schema)


def extract(pages: DataFrame, extra: Fields | None = None, timeout: float | None = 10.0) -> DataFrame:
    """Records of pages (domain, identifier, level, url, session_date, path, html): domain, identifier, level, website, date,
    path, meta, zipcode, address, the extra fields in order of their names, text. A failed page's path says why, and all its
    fields are null."""
    extra = extra or Fields()
    t = tokenized(pages.select("domain", "identifier", "level", "url", "session_date", "path", "html"), extra.page, timeout)
    cols = {"text": F.col("html_text"), "html": F.col("html"), "url": F.col("url"), "hrefs": F.col("hrefs")}
    own = {n: F.when(F.col("error").isNull(), make(cols)) for n, make in extra.sql.items()} | {n: F.try_element_at("plugin", F.lit(n)) for n in extra.page}
    zips = own.pop("zipcode", X.zipcodes("html_text"))
    return t.withColumn("_zip", zips).select(
        "domain", "identifier", "level", F.col("url").alias("website"), F.col("session_date").alias("date"), F.coalesce("error", "path").alias("path"), "meta",
        F.col("_zip").alias("zipcode"), own.pop("address", X.addresses("html_text", "_zip")).alias("address"), *(own[n].alias(n) for n in sorted(own)), F.col("html_text").alias("text"),
    )


def is_error(records: DataFrame) -> DataFrame:
    return records.where(F.col("path").isin(FAILED, TIMED_OUT))
