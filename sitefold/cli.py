"""The command line: init, restore, config, crawl, extract, consolidate."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from . import __version__
from .sources import archive, ndjson, overview_log, seeds
from .sources.settings import Settings, has_crawled_data, load_plugin


def _session(name: str):
    from pyspark.sql import SparkSession

    from .shipping import ship

    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def _date(text: str) -> str:
    return datetime.date.fromisoformat(text).isoformat()


def _window(start: str | None, end: str | None) -> tuple[str, str]:
    """Both dates or none, in order."""
    if (start is None) != (end is None):
        raise SystemExit("give both --start-date and --end-date, or neither")
    if start and start > end:
        raise SystemExit("--start-date is after --end-date")
    return start or "0000-01-01", end or "9999-01-01"


def _ready(folder: str, need_pages: bool = False) -> Settings:
    s = Settings(folder)
    if not s.initialised():
        raise SystemExit(f"{folder} has no settings; run init first")
    if need_pages and not has_crawled_data(s.target_folder):
        raise SystemExit("nothing has been crawled yet")
    return s


def _log(s: Settings) -> tuple[str, str]:
    """Where the instance's log is, and its storage: a tab-separated one without a database, else Parquet, which stands in for
    database files. A log that is there already is gone on with."""
    folders = {"parquet": f"{s.target_folder}/overview", "csv": f"{s.target_folder}/overview_tsv"}
    there = [f for f, path in folders.items() if Path(path).exists()]
    fmt = there[0] if there else "csv" if overview_log.resolve_backend(s.target_folder, use_database=s.use_database) == "csv" else "parquet"
    return folders[fmt], fmt


def _crawl(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from .functions.domains import host_of
    from .functions.robots import parse_robots
    from .functions.rules import load_rules
    from .operators import crawl as C
    from .operators import overview as O
    from .shared import cut
    from .sources.fetch import Fetcher

    s, spark = _ready(a.folder), _session("sitefold crawl")
    log_path, fmt = _log(s)
    log = overview_log.read_log(spark, log_path, fmt) if Path(log_path).exists() else None
    today = a.date or datetime.date.today().isoformat()
    if a.complement:
        if log is None:
            raise SystemExit("there is no log yet, so nothing to ask again")
        wanted = O.complement(log.withColumn("ord", F.monotonically_increasing_id()), a.complement)
    else:
        wanted = seeds.read_source_urls(spark, s.source_file).select("url", "identifier")
    config = C.CrawlConfig(max_level=a.max_level, max_pages=a.max_pages, recrawl_days=a.recrawl_days, rules=load_rules(a.rules, a.allow, a.block))
    got = 0
    for _ in range(1 if a.pages else 2):  # a run over the network that gets nothing is tried once more
        store = spark.read.parquet(a.pages) if a.pages else Fetcher(timeout=a.timeout)
        robots = parse_robots(spark.read.parquet(a.robots)) if a.robots else None if a.pages else store.robots(wanted)
        done = cut(C.crawl(wanted, store, today, config, robots=robots, log=log))
        got = done.where("status = '200'").count()
        if got:
            break
    overview_log.append_log(done, log_path, fmt, once=True)
    pages = store if a.pages else store.pages()
    pages = done.where("status = '200'").dropDuplicates(["url"]).join(pages.select("url", "html").dropDuplicates(["url"]), "url")
    if a.extract:  # pages go straight into records; none is kept
        from .operators import extract as E

        records = E.extract(pages, E.contact_fields() if a.contacts else None)
        ndjson.write_records(records, f"{s.target_folder}/extracted_data", today)
    elif not a.no_html:
        html = pages.select(F.regexp_replace(host_of("url"), r"www\.", "").alias("zip_name"), F.regexp_replace("path", r"^[^/]+/", "").alias("member"), F.col("html").cast("binary").alias("content"))
        archive.write_archives(html, f"file://{Path(s.target_folder).resolve()}/crawled_data")
    print(f"{got} pages")
    return 0


def _extract(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from .functions.domains import host_of
    from .operators import extract as E
    from .operators import overview as O

    s, spark = _ready(a.folder, need_pages=True), _session("sitefold extract")
    start, end = _window(a.start_date, a.end_date)
    extra, why = load_plugin(s.addon_file) if s.addon_file else (None, "ok")
    if why != "ok":
        print(why, file=sys.stderr)
    if a.contacts:
        own = E.contact_fields()
        own.page |= extra.page if extra else {}
        extra = own
    rows = O.success_window(overview_log.read_log(spark, *_log(s)), start, end)
    where = F.concat(F.lit("crawled_data/"), F.regexp_replace(host_of("url"), r"www\.", ""), F.lit("/"), F.regexp_replace("path", r"^[^/]+/", ""))
    folder = f"file://{Path(s.target_folder).resolve()}/crawled_data"
    pages = archive.with_pages(rows.withColumn("path", where), archive.read_archives(spark, folder))
    records = E.extract(pages, extra, a.timeout)
    ndjson.write_records(records, f"{s.target_folder}/extracted_data", datetime.date.today().isoformat(), a.append)
    if s.delete_after:
        overview_log.delete_sessions(spark, folder, start, end)
    return 0


def _consolidate(a: argparse.Namespace) -> int:
    from .operators import consolidate as C

    s, spark = _ready(a.folder), _session("sitefold consolidate")
    source = a.input or ndjson.latest_run(spark, f"{s.target_folder}/extracted_data")
    records = ndjson.read_records(spark, source)
    ndjson.write_consolidated(C.consolidated(records, chunk_size=a.chunk_size), ndjson.output_path(a.output, target_folder=s.target_folder, source=source))
    return 0


def _init(a: argparse.Namespace) -> int:
    s = Settings(a.folder)
    s.target_folder = a.target
    Path(a.target).mkdir(parents=True, exist_ok=True)
    if a.source:
        s.source_file = a.source
    if a.addon:
        s.keep_addon(a.addon)
    s.delete_after = a.delete
    s.use_database = not a.no_database
    return 0


def _restore(a: argparse.Namespace) -> int:
    return 0 if Settings(a.folder).restore(a.target) else 1


def _config(a: argparse.Namespace) -> int:
    s = _ready(a.folder)
    if a.source:
        s.source_file = a.source
    if a.addon:
        s.keep_addon(a.addon)
    if a.delete is not None:
        s.delete_after = a.delete
    print(f"target {s.target_folder}\nsource {s.source_file}\naddon {s.addon_file}\ndelete {s.delete_after}\nstorage {overview_log.resolve_backend(s.target_folder, use_database=s.use_database)}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sitefold", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--folder", default=".", help="the instance's folder")
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("init")
    c.add_argument("target")
    c.add_argument("--source")
    c.add_argument("--addon")
    c.add_argument("--delete", action="store_true")
    c.add_argument("--no-database", action="store_true")
    c.set_defaults(run=_init)
    c = sub.add_parser("restore")
    c.add_argument("target")
    c.set_defaults(run=_restore)
    c = sub.add_parser("config")
    c.add_argument("--source")
    c.add_argument("--addon")
    c.add_argument("--delete", action=argparse.BooleanOptionalAction)
    c.set_defaults(run=_config)
    c = sub.add_parser("crawl")
    c.add_argument("--pages", help="a page store: Parquet with url and html; without one pages are fetched")
    c.add_argument("--robots", help="Parquet with host and body of robots.txt; without a page store they are fetched")
    c.add_argument("--timeout", type=float, default=120.0)
    c.add_argument("--extract", action="store_true", help="write records at once and keep no pages")
    c.add_argument("--contacts", action="store_true")
    c.add_argument("--date", type=_date)
    c.add_argument("--complement", type=_date, help="ask again what failed in this session")
    c.add_argument("--max-level", type=int, default=3)
    c.add_argument("--max-pages", type=int, default=50)
    c.add_argument("--recrawl-days", type=int, default=30)
    c.add_argument("--rules")
    c.add_argument("--allow")
    c.add_argument("--block")
    c.add_argument("--no-html", action="store_true")
    c.set_defaults(run=_crawl)
    c = sub.add_parser("extract")
    c.add_argument("--start-date", type=_date)
    c.add_argument("--end-date", type=_date)
    c.add_argument("--contacts", action="store_true")
    c.add_argument("--timeout", type=float, default=10.0)
    c.add_argument("--append", action="store_true")
    c.set_defaults(run=_extract)
    c = sub.add_parser("consolidate")
    c.add_argument("--input")
    c.add_argument("--output")
    c.add_argument("--chunk-size", type=int)
    c.set_defaults(run=_consolidate)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
