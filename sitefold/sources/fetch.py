"""Pages over HTTP as a Python data source, and the fetcher that crawls use. Tests and queries use a page store instead."""

from __future__ import annotations

import email.utils
import functools
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.robots import RULES, parse_robots
from ..functions.urls import authority, with_scheme
from ..shared import new_path
from ..streaming.crawl_stream import wait_step

SCHEMA = "url string, status string, html string, retry_after string"
FAILED = "Base URL crawl failed"
AGENT = "Mozilla/5.0 (compatible; sitefold)"


def fetch(url: str, timeout: float = 180.0, opener: Callable | None = None) -> tuple[str, str, str | None, str | None]:
    """url, status, html (of status 200 alone), Retry-After."""
    ask = urllib.request.Request(url, headers={"User-Agent": AGENT})
    try:
        with (opener or urllib.request.urlopen)(ask, timeout=timeout) as r:
            body = r.read()
            return url, str(r.status), body.decode("utf-8", "ignore") if r.status == 200 else None, r.headers.get("Retry-After")
    except urllib.error.HTTPError as e:
        return url, str(e.code), None, e.headers.get("Retry-After") if e.headers else None
    except Exception as e:  # the message tells what went wrong
        return url, phrase_of(e), None, None


def phrase_of(e: BaseException) -> str:
    m = str(e).lower()
    if "timed out" in m or isinstance(e, TimeoutError):
        return "Request timeout"
    if "name or service not known" in m or "nodename nor servname" in m:
        return "DNS lookup failed"
    return "Connection failed" if "cannot connect to host" in m or "refused" in m else "Request failed"


def attempts(url: str, ask: Callable[[str], tuple], wait: Callable[[float], None], domain_wait: float = 0.0, delays: tuple[float, ...] = (0.0, 6.0, 18.0), errors: int = 0, most_errors: int = 20) -> tuple[tuple, int]:
    """The last answer, and the seed's errors so far. Only failures without an HTTP answer are tried again, each after its
    delay or the domain's wait if that is longer; a seed with too many errors isn't asked any more."""
    answer = (url, "One URL: Too many errors in domain", None, None)
    for d in delays:
        if errors >= most_errors:
            break
        wait(max(d, domain_wait))
        answer = ask(url)
        if answer[1].isdigit():
            break
        errors += 1
    return answer, errors


def domain_answers(urls: list[str], ask: Callable[[str], tuple], sleep: Callable[[float], None], level: int = 0, known: bool = False) -> Iterator[tuple]:
    """The answers of one domain's URLs, one after another. The wait between them follows what the domain answers: longer after
    refusals and failures, slowly shorter otherwise. What goes wrong besides a request ends in an answer too."""
    wait, errors = 0.0 if level == 0 or known else 0.35, 0
    for u in urls:
        try:
            answer, errors = attempts(u, ask, sleep, wait, errors=errors)
        except Exception as e:  # one bad URL mustn't end the domain's crawl
            answer = (u, FAILED, None, f"One base URL: {e}")
        wait = wait_step(wait, answer[1], seconds_of(answer[3]))
        yield answer


def seconds_of(header: str | None) -> float | None:
    """Seconds of a Retry-After header: a number, or a date's distance from now."""
    text = (header or "").strip()
    if text.isdigit():
        return float(text)
    try:
        return max(0.0, email.utils.parsedate_to_datetime(text).timestamp() - time.time())
    except (TypeError, ValueError):
        return None


def fetched(urls: DataFrame, domain: str = "domain", ask: Callable[[str], tuple] | None = None, sleep: Callable[[float], None] = time.sleep, level: int = 0) -> DataFrame:
    """The answers to urls (url, and their domain). A domain's URLs are asked one after another by one task, different
    domains' in parallel; rows leave as they come."""
    get = ask or fetch

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, mine = None, []

        def answers():
            for answer in domain_answers(mine, get, sleep, level):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in answer], names=["url", "status", "html", "retry_after"])

        for b in batches:
            for d, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d != now and mine:
                    yield from answers()
                    mine = []
                now = d
                mine.append(u)
        yield from answers()

    return urls.select(domain, "url").repartition(domain).sortWithinPartitions(domain, "url").mapInArrow(run, SCHEMA)


class Fetcher:
    """Fetches the pages of a crawl, level by level, and keeps the answers in the shared folder, so that nothing is asked twice
    however often a plan reads them. ask and sleep can be replaced, as in tests."""

    def __init__(self, timeout: float = 180.0, ask: Callable[[str], tuple] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.ask = ask or functools.partial(fetch, timeout=timeout)
        self.sleep = sleep
        self.answers: list[DataFrame] = []

    def fetch(self, urls: DataFrame, level: int) -> DataFrame:
        spark = urls.sparkSession
        path = new_path(spark, "fetched")
        fetched(urls, ask=self.ask, sleep=self.sleep, level=level).write.option("compression", "zstd").parquet(path)
        self.answers.append(spark.read.schema(SCHEMA).parquet(path))
        return self.answers[-1]

    def robots(self, seeds: DataFrame) -> DataFrame:
        """host, allow, pattern of the seeds' hosts, each asked once."""
        ask, sleep = self.ask, self.sleep

        def run(batches):
            for b in batches:
                rows = [(h, fetch_robots(f"https://{h}", ask, sleep)[1]) for h in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["host", "body"])

        hosts = seeds.select(authority(with_scheme("url")).alias("host")).where("host <> ''").distinct()
        path = new_path(seeds.sparkSession, "robots")
        parse_robots(hosts.mapInArrow(run, "host string, body string")).write.parquet(path)
        return seeds.sparkSession.read.schema(RULES).parquet(path)

    def pages(self) -> DataFrame | None:
        """url, status, html of everything that was fetched."""
        return functools.reduce(DataFrame.unionByName, self.answers).select("url", "status", "html") if self.answers else None


class PageSource(DataSource):
    """spark.read.format("pages").option("urls", "https://a https://b").load()"""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = (options.get("urls") or "").split()
        self.timeout = float(options.get("timeout", "180"))

    def partitions(self) -> list[InputPartition]:
        from urllib.parse import urlsplit

        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [InputPartition(v) for v in hosts.values()]

    def read(self, partition: InputPartition):
        for u in partition.value:
            yield fetch(u, self.timeout)


def robots_candidates(url: str) -> list[str]:
    """Addresses of a site's robots.txt, the safe one first."""
    from urllib.parse import urlsplit

    host = urlsplit(url if "://" in url else f"https://{url}").netloc
    return [f"{s}://{host}/robots.txt" for s in ("https", "http")] if host else []


def fetch_robots(url: str, ask: Callable[[str], tuple] = fetch, wait: Callable[[float], None] = lambda s: None, tries: tuple[float, ...] = (0.0, 1.0)) -> tuple[str, str | None]:
    """The scheme that answered, and the rules' text; "" allows everything, as do answers of 400 and above and failures; None
    if the URL has no host."""
    found = robots_candidates(url)
    if not found:
        return "https", None
    for c in found:
        for d in tries:
            wait(d)
            _, status, body, _ = ask(c)
            if status.isdigit():
                return c.split(":")[0], (body or "") if int(status) < 400 else ""
    return "https", ""
