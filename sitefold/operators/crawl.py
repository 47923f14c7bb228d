"""Breadth-first crawls over a page store, level by level as DataFrame steps.

The frontier of a level has seed, url, identifier, level and rank (its order). Each level: robots, budget, classification,
fetch (a join with the store's links, or requests), links, within-domain filter, and what was seen before goes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.domains import SuffixRules, host_of, registered_domain
from ..functions.robots import allowed as robots_allowed
from ..functions.rules import Rules, classify_url, load_rules
from ..functions.urls import authority, clean_url, keeps_host, let, page_path, path, query, with_scheme
from ..shared import cut
from . import links as L
from .overview import rows as log_rows
from .overview import skip_recent


@dataclass
class CrawlConfig:
    """Bounds of a crawl. The page budget lets one page more than max_pages through, and counts pages that classification
    then rejects; that is how budgets of existing crawls were counted."""

    max_level: int = 3
    max_pages: int = 50
    recrawl_days: int = 30
    strict_host: bool = False
    link_base: str = "site"
    rules: Rules = field(default_factory=load_rules)
    suffixes: SuffixRules | None = None


def in_memory_seeds(spark: SparkSession, seeds: list) -> DataFrame:
    """url, identifier, ord of a list of URLs, (url, id) and (id, url) pairs. Which is the URL tells the first that starts with
    http:// or https://; other things and empty pairs are passed over; a blank identifier becomes the domain."""
    rows = []
    for s in seeds:
        if isinstance(s, str):
            rows.append((len(rows), s, None))
        elif isinstance(s, (tuple, list)) and s:
            pair = [None if x is None else str(x) for x in (*s, None)][:2]
            rows.append((len(rows), *pair))
    df = spark.createDataFrame(rows, "ord long, a string, b string")
    web = r"^https?://"
    swap = ~F.coalesce(F.col("a").rlike(web), F.lit(False)) & F.coalesce(F.col("b").rlike(web), F.lit(False))
    url = with_scheme(F.when(swap, F.col("b")).otherwise(F.col("a")))
    return df.select("ord", url.alias("url"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("i")).where("url is not null").select("ord", "url", F.when(F.trim(F.coalesce("i", F.lit(""))) == "", registered_domain("url")).otherwise(F.col("i")).alias("identifier"))


def budgeted(frontier: DataFrame, used: DataFrame, max_pages: int) -> DataFrame:
    """The frontier's first rows by rank, as many as the seeds' budgets leave: max_pages - used + 1 if used is below max_pages."""
    quota = F.when(F.coalesce("used", F.lit(0)) < max_pages, max_pages - F.coalesce("used", F.lit(0)) + 1).otherwise(0)
    order = Window.partitionBy("seed").orderBy("rank")
    return frontier.join(used, "seed", "left").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= quota).drop("_n", "used")


def bfs(seeds: DataFrame, edges: DataFrame, max_level: int = 3, max_pages: int | None = None, follow: Column | None = None, url: str = "url") -> DataFrame:
    """seed, level, url, rank of what a crawl visits over edges (src_url, pos, dst_url) from seeds (seed, url): each clean URL
    once for a seed, at its lowest level; of one level the order is that of the parents, then of the links. follow: which rows
    of (url, level) have links that are followed; others are visited only."""
    frontier = seeds.select("seed", F.lit(0).alias("level"), F.col(url).alias("url"), F.lit(0).cast("long").alias("rank"))
    links = edges.select(clean_url("src_url").alias("_src"), "pos", F.col("dst_url").alias("_dst"))
    seen = used = None
    out = None
    for level in range(max_level):
        if max_pages is not None:
            used = seeds.select("seed", F.lit(0).cast("long").alias("used")).distinct() if out is None else out.groupBy("seed").agg(F.count("*").alias("used"))
            frontier = budgeted(frontier, used, max_pages)
        frontier = cut(frontier)
        out = frontier if out is None else out.unionByName(frontier)
        keys = frontier.select("seed", clean_url("url").alias("key"))
        seen = keys if seen is None else seen.unionByName(keys)
        if level + 1 == max_level:
            break
        from_here = frontier if follow is None else frontier.where(follow)
        nxt = from_here.join(links, clean_url("url") == F.col("_src")).select("seed", F.col("_dst").alias("url"), clean_url("_dst").alias("key"), F.struct("rank", "pos").alias("at"))
        fresh = nxt.join(seen, ["seed", "key"], "left_anti").groupBy("seed", "key").agg(F.min_by("url", "at").alias("url"), F.min("at").alias("at"))
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("at"))
        frontier = fresh.select("seed", F.lit(level + 1).alias("level"), "url", rank.cast("long").alias("rank"))
    return out


NO_SITE, NO_SITE_PATH = "Website not found in __test_domain_robots", "Domain robots URL: invalid URL"
#: Sites up to which a store is filtered by them in its scan.
FEW_SITES = 1_000_000


def _of_store(store: DataFrame, start: DataFrame, c: CrawlConfig) -> tuple[DataFrame, DataFrame]:
    """key, status of each clean URL of a store; and key, pos, href of their links. Of several pages of a clean URL the first URL
    counts, of several bodies of that the first digest. Bodies stay where they are: they are parsed once, in the scan, only
    pages of the seeds' sites, and just keys, digests and links are shuffled."""
    status = F.col("status") if "status" in store.columns else F.lit("200")
    own = store.select("url", "html", clean_url("url").alias("key"), status.cast("string").alias("status"), F.md5(F.coalesce("html", F.lit(""))).alias("digest")).where("url is not null")
    sites = start.select(F.col("site").alias("_site")).distinct()
    if not c.strict_host and sites.count() <= FEW_SITES:
        own = own.join(F.broadcast(sites), registered_domain("url", c.suffixes) == F.col("_site"), "left_semi")
    index = cut(own.groupBy("key").agg(F.min(F.struct("url", "digest", "status", F.col("html").isNotNull().alias("there"))).alias("p")).select("key", "p.*"))
    readable = own.where("html is not null and status = '200'")
    found = L.hrefs(readable, keep=("key", "digest"))
    same = index.select("key", F.col("url").alias("src_url"), "digest")
    return index.select("key", "status"), cut(found.join(same, ["key", "src_url", "digest"]).select("key", "pos", "href").distinct())


def crawl(seeds: DataFrame, store, today: str, config: CrawlConfig | None = None, robots: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Log rows (with seed and rank) of a crawl of seeds (url, identifier). store: a page store (url, html; status if it has one),
    whose missing pages get "404", or something that fetches, such as sources.fetch.Fetcher. robots: rules as
    functions.robots makes them; log: earlier rows, whose recent successes aren't fetched again. Seeds without a host get a
    row that says so."""
    c = config or CrawlConfig()
    start = seeds.withColumn("url", with_scheme("url")).where("url is not null")
    if log is not None:
        start = skip_recent(start, log, today, c.recrawl_days)
    seed = F.xxhash64("url", F.coalesce("identifier", F.lit("")))
    start = start.select(seed.alias("seed"), "url", "identifier").dropDuplicates(["seed"]).withColumn("domain", registered_domain("url", c.suffixes))
    start = cut(start.select("seed", "url", F.coalesce("identifier", "domain").alias("identifier"), "domain", (F.regexp_replace(host_of("url"), r"www\.", "") if c.strict_host else F.col("domain")).alias("site")))
    lost = start.where(authority("url") == "").select("seed", F.lit(0).cast("long").alias("rank"), "identifier", F.lit(0).alias("level"), "url", F.lit(NO_SITE).alias("status"), F.lit(NO_SITE_PATH).alias("path"), "domain")
    start = start.where(authority("url") != "")
    in_store = isinstance(store, DataFrame)
    index, links = _of_store(store, start, c) if in_store else (None, None)
    frontier = start.select("seed", "url", clean_url("url").alias("key"), "identifier", "site", "domain", F.lit(0).alias("level"), F.lit(0).cast("long").alias("rank"))
    seen = out = None
    for level in range(c.max_level):
        if robots is not None:
            asked = frontier.withColumns({"host": authority("url"), "target": F.concat(F.when(path("url") == "", "/").otherwise(path("url")), F.when(query("url") != "", F.concat(F.lit("?"), query("url"))).otherwise(""))})
            frontier = robots_allowed(asked, robots).where("allowed").drop("host", "target", "allowed")
        used = start.select("seed", F.lit(0).cast("long").alias("used")) if out is None else out.groupBy("seed").agg(F.count("*").alias("used"))
        visited = cut(budgeted(frontier, used, c.max_pages).withColumn("followed", classify_url("url", "level", c.rules)))
        out = visited if out is None else out.unionByName(visited)
        keys = visited.select("seed", "key")
        seen = keys if seen is None else seen.unionByName(keys)
        if not in_store:
            got = store.fetch(visited.where("followed").select(F.col("site").alias("domain"), "url").distinct(), level)
            fresh = got.select(clean_url("url").alias("key"), "status").dropDuplicates(["key"])
            index = fresh if index is None else index.unionByName(fresh).dropDuplicates(["key"])
            links = L.hrefs(got.where("html is not null and status = '200'").withColumn("key", clean_url("url")), keep=("key",)).select("key", "pos", "href")
        if level + 1 == c.max_level:
            break
        # links that name no host stay in their page's domain; the others are resolved to tell
        dst = L.resolve_link("url", "href", c.link_base)
        inside = F.when(keeps_host("url", "href"), F.col("domain") == F.col("site")).otherwise(registered_domain(dst, c.suffixes) == F.col("site"))
        found = visited.where("followed").select("seed", "identifier", "site", "domain", "rank", "url", "key").join(links, "key").where(inside)
        near = found.select("seed", "identifier", "site", F.struct("rank", "pos").alias("at"), let(L.strip_query_and_fragment(dst), lambda u: F.struct(u.alias("url"), clean_url(u).alias("key"))).alias("to")).select("seed", "identifier", "site", "at", "to.*")
        fresh = near.join(seen, ["seed", "key"], "left_anti").groupBy("seed", "identifier", "site", "key").agg(F.min_by("url", "at").alias("url"), F.min("at").alias("at"))
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("at")).cast("long")
        frontier = fresh.select("seed", "url", "key", "identifier", "site", F.col("site").alias("domain"), F.lit(level + 1).alias("level"), rank.alias("rank"))
    answers = index.select("key", F.col("status").alias("_status"))
    done = out.where("followed").join(answers, "key", "left")
    rows = done.select("seed", "rank", "identifier", "level", "url", F.coalesce("_status", F.lit("404")).alias("status"), F.when(F.col("_status") == "200", page_path("site", "url", F.lit(today))).alias("path"), "domain")
    dated = rows.unionByName(lost).withColumns({"session_date": F.lit(today), "crawl_date": F.concat(F.lit(today), F.lit(" 00:00:00"))})
    return log_rows(dated, c.suffixes, "seed", "rank", domain="domain")
