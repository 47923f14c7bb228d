"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import fields as X
from ..functions import robots as R
from ..functions import statuses as S
from ..functions import urls as U
from ..functions.rules import classify_url, load_rules
from ..operators import consolidate as C
from ..operators import crawl as B
from ..operators import extract as E
from ..operators import links as L
from ..operators import overview as O
from ..shared import new_path
from ..streaming import crawl_stream as W
from . import derived as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str | Callable[[], str]] = {}

#: Suffix rules that the SQL can hold; queries with SQL use them instead of the whole list.
SUFFIXES = D.SuffixRules(frozenset({"com", "net", "org", "nl", "uk", "co.uk", "ac.uk", "jp"}), frozenset({"kobe.jp", "ck"}), frozenset({"city.kobe.jp", "www.ck"}))
SPLIT = r"(?s)^(([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def _query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL, or with what makes it once it is asked for."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql if callable(sql) else sql.strip()
        return f

    return add


def _x(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{SPLIT}', {group})"


def _list(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in sorted(names)) + "]"


def _sql_host(url: str) -> str:
    return f"lower(regexp_extract(CASE WHEN {_x(url, 4)} <> '' THEN {_x(url, 4)} ELSE {url} END, '^([^/:]*)', 1))"


def _sql_suffix(labels: str) -> str:
    """First label of the public suffix of a list of labels."""
    tail = lambda i: f"array_to_string(list_slice({labels}, {i}, len({labels})), '.')"
    first = lambda cond: f"list_min([i FOR i IN range(1, len({labels}) + 1) IF {cond}])"
    plain, wild, exc = first(f"list_contains({_list(SUFFIXES.plain)}, {tail('i')})"), first(f"i < len({labels}) AND list_contains({_list(SUFFIXES.wild)}, {tail('(i + 1)')})"), first(f"list_contains({_list(SUFFIXES.exceptions)}, {tail('i')})")
    return f"coalesce({exc} + 1, least({plain}, {wild}))"


_TAIL = "array_to_string(list_slice(labels, len(labels) - 1, len(labels)), '.')"
_DIGITS = "len(labels) > 0 AND len([x FOR x IN labels IF NOT regexp_full_match(x, '[0-9]+')]) = 0"


def _sql_domains(source: str, url: str = "url") -> str:
    """CTEs h and dom: registered and clean domain of each row of source."""
    return f"""h AS (SELECT *, {_sql_host(url)} AS full_host FROM {source}),
h2 AS (SELECT *, [x FOR x IN string_split(full_host, '.') IF x <> ''] AS fl, [x FOR x IN string_split(replace(full_host, 'www.', ''), '.') IF x <> ''] AS labels FROM h),
h3 AS (SELECT *, {_sql_suffix('fl')} AS sfx FROM h2),
h4 AS (SELECT *, CASE WHEN sfx > 1 THEN array_to_string(list_slice(fl, sfx - 1, len(fl)), '.') END AS listed FROM h3),
dom AS (SELECT *, CASE WHEN {_DIGITS} THEN array_to_string(labels, '.') WHEN len(labels) >= 3 AND length(labels[-1]) = 2 AND length(labels[-2]) <= 3 THEN coalesce(replace(listed, 'www.', ''), {_TAIL}) WHEN len(labels) >= 2 THEN {_TAIL} ELSE replace(full_host, 'www.', '') END AS registered,
 coalesce(listed, CASE WHEN {_DIGITS} THEN array_to_string(labels, '.') WHEN len(labels) >= 2 THEN {_TAIL} ELSE replace(full_host, 'www.', '') END) AS clean FROM h4)"""


# --- URLs


@_query(f"WITH {_sql_domains('pages')} SELECT registered AS domain, count(*) AS pages, string_agg(regexp_replace(url, '(https?://)?(www\\.)?', '', 'g'), ' ' ORDER BY page_id) AS urls FROM dom GROUP BY registered")
def q_pages_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "pages").select("page_id", D.registered_domain("url", SUFFIXES).alias("domain"), U.clean_url("url").alias("u"))
    urls = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "u"))), lambda x: x["u"]), " ")
    return rows.groupBy("domain").agg(F.count("*").alias("pages"), urls.alias("urls"))


@_query(f"SELECT page_id, lower({_x('url', 2)}) AS scheme, {_x('url', 4)} AS host, {_x('url', 5)} AS path, {_x('url', 7)} AS query, {_x('url', 9)} AS fragment FROM pages")
def q_url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", U.scheme("url").alias("scheme"), U.authority("url").alias("host"), U.path("url").alias("path"), U.query("url").alias("query"), U.fragment("url").alias("fragment"))


@_query(r"SELECT page_id, regexp_replace(url || '&to=https://www.b.nl', '(https?://)?(www\.)?', '', 'g') AS clean FROM pages")
def q_clean_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", U.clean_url(F.concat("url", F.lit("&to=https://www.b.nl"))).alias("clean"))


@_query(f"SELECT page_id, lower(regexp_extract(regexp_extract({_x('url', 5)}, '([^/]+)/*$', 1), '^.+\\.([^.]+)$', 1)) AS extension FROM pages")
def q_url_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", U.url_extension("url").alias("extension"))


@_query("SELECT page_id, regexp_replace(url, '(?s)[?#].*$', '') AS bare FROM pages")
def q_strip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", U.strip_query_and_fragment("url").alias("bare"))


_TRIM = r"regexp_replace(url, '^\s+|\s+$', '', 'g')"
_SCHEMED = f"u AS (SELECT *, {_TRIM} AS tr FROM s), w AS (SELECT *, CASE WHEN tr = '' OR regexp_matches(tr, '(?i)^(mailto|mail|tel|javascript):') THEN NULL WHEN {_x('tr', 2)} = '' THEN 'https://' || regexp_replace(tr, '^/+', '') ELSE tr END AS base FROM u)"


@_query(
    f"WITH {T.SEEDS}, {_SCHEMED} SELECT id, base AS base_url, CASE WHEN lower({_x('base', 2)}) IN ('http','https') AND {_x('base', 4)} <> '' THEN lower({_x('base', 2)}) || '://' || {_x('base', 4)} || {_x('base', 5)} || CASE WHEN {_x('base', 7)} <> '' THEN '?' || {_x('base', 7)} ELSE '' END END AS source_url FROM w"
)
def q_normalize_source_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.seed_texts(spark, sf_dir).select("id", U.normalize_base_url("url").alias("base_url"), U.normalize_source_url("url").alias("source_url"))


_HOSTS = "p AS (SELECT page_id AS id, CASE page_id % 7 WHEN 0 THEN replace(url, '.example.com', '.co.uk') WHEN 1 THEN replace(url, 'example.net', 'a.kobe.jp') WHEN 2 THEN 'http://10.0.0.' || page_id || ':80/x' WHEN 3 THEN replace(url, 'example', 'city.kobe.jp/example') WHEN 4 THEN 'http://WWW.x' || page_id || '.ck/' WHEN 5 THEN 'localhost' || page_id ELSE url END AS url FROM pages)"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("page_id"), F.col("url")
    n = k.cast("string")
    url = (
        F.when(k % 7 == 0, F.replace(u, F.lit(".example.com"), F.lit(".co.uk"))).when(k % 7 == 1, F.replace(u, F.lit("example.net"), F.lit("a.kobe.jp"))).when(k % 7 == 2, F.concat(F.lit("http://10.0.0."), n, F.lit(":80/x")))
        .when(k % 7 == 3, F.replace(u, F.lit("example"), F.lit("city.kobe.jp/example"))).when(k % 7 == 4, F.concat(F.lit("http://WWW.x"), n, F.lit(".ck/"))).when(k % 7 == 5, F.concat(F.lit("localhost"), n)).otherwise(u)
    )
    return T.table(spark, sf_dir, "pages").select(k.alias("id"), url.alias("url"))


@_query(f"WITH {_HOSTS}, {_sql_domains('p')} SELECT id, registered FROM dom")
def q_registered_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosts(spark, sf_dir).select("id", D.registered_domain("url", SUFFIXES).alias("registered"))


@_query(f"WITH {_HOSTS}, {_sql_domains('p')} SELECT id, clean FROM dom")
def q_clean_domain_psl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosts(spark, sf_dir).select("id", D.clean_domain("url", SUFFIXES).alias("clean"))


def _full_list_sql() -> str:
    """The whole list as a table of each kind of rule, joined to every tail of a host."""
    rules = D.default_rules()
    kinds = ", ".join(f"{name} AS (SELECT unnest({_list(of)}) AS r)" for name, of in (("plain", rules.plain), ("wild", rules.wild), ("exc", rules.exceptions)))
    tail = lambda i: f"array_to_string(list_slice(fl, {i}, len(fl)), '.')"
    return f"""WITH {_HOSTS}, {kinds}, h AS (SELECT *, {_sql_host('url')} AS full_host FROM p),
h2 AS (SELECT *, [x FOR x IN string_split(full_host, '.') IF x <> ''] AS fl, [x FOR x IN string_split(replace(full_host, 'www.', ''), '.') IF x <> ''] AS labels FROM h),
c AS (SELECT id, i, {tail('i')} AS tail, CASE WHEN i < len(fl) THEN {tail('i + 1')} END AS parent FROM (SELECT id, fl, unnest(range(1, len(fl) + 1)) AS i FROM h2)),
m AS (SELECT id, min(i) FILTER (WHERE exc.r IS NOT NULL) AS e, min(i) FILTER (WHERE plain.r IS NOT NULL OR wild.r IS NOT NULL) AS first FROM c LEFT JOIN plain ON plain.r = tail LEFT JOIN wild ON wild.r = parent LEFT JOIN exc ON exc.r = tail GROUP BY id),
s AS (SELECT h2.*, coalesce(e + 1, first) AS sfx FROM h2 LEFT JOIN m USING (id))
SELECT id, coalesce(CASE WHEN sfx > 1 THEN {tail('sfx - 1')} END, CASE WHEN {_DIGITS} THEN array_to_string(labels, '.') WHEN len(labels) >= 2 THEN {_TAIL} ELSE replace(full_host, 'www.', '') END) AS clean FROM s"""


@_query(_full_list_sql)
def q_clean_domain_full_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the whole public suffix list."""
    return _hosts(spark, sf_dir).select("id", D.clean_domain("url").alias("clean"))


_RULES = load_rules()
_TARGETS = "c AS (SELECT page_id, level, CASE page_id % 6 WHEN 0 THEN url || '.pdf' WHEN 1 THEN 'https://shop.example.com/Contact' WHEN 2 THEN 'https://x.example.com/553-504' WHEN 3 THEN 'https://x.example.com/zoeken/a' WHEN 4 THEN 'MAILTO:a@example.com' ELSE url END AS url FROM pages, range(4) r(level))"


@_query(
    f"""WITH {_TARGETS}, d AS (SELECT *, {_x('url', 5)} AS path, lower(regexp_extract(regexp_extract({_x('url', 5)}, '([^/]+)/*$', 1), '^.+\\.([^.]+)$', 1)) AS ext FROM c)
SELECT page_id, CAST(level AS INTEGER) AS level, CASE WHEN level = 0 THEN true WHEN regexp_matches(url, '(?i)^(mailto|tel):') THEN false WHEN ext IN ('jpeg','jpg','pdf','png') THEN false WHEN regexp_matches(path, '{_RULES.negative}') THEN false
 WHEN level = 1 THEN NOT regexp_matches(path, '^[^a-zA-Z]+$') WHEN level = 2 THEN regexp_matches(path, '{_RULES.positive}') ELSE false END AS followed FROM d"""
)
def q_classify_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 6 == 0, F.concat("url", F.lit(".pdf"))).when(k % 6 == 1, "https://shop.example.com/Contact").when(k % 6 == 2, "https://x.example.com/553-504").when(k % 6 == 3, "https://x.example.com/zoeken/a").when(k % 6 == 4, "MAILTO:a@example.com").otherwise(F.col("url"))
    rows = T.table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.explode(F.array(*map(F.lit, range(4)))).alias("level"))
    return rows.select("page_id", "level", classify_url("url", "level").alias("followed"))


@_query(f"SELECT page_id, replace('example.com/' || regexp_replace({_x('url', 4)}, 'www\\.', '', 'g') || '/2024-01-31/' || CASE WHEN string_split(regexp_replace(url, '/$', ''), '/')[-1] = '' THEN 'index' ELSE string_split(regexp_replace(url, '/$', ''), '/')[-1] END, ' ', '_') AS archive_path FROM pages")
def q_page_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", U.page_path(F.lit("example.com"), "url", F.lit("2024-01-31")).alias("archive_path"))


# --- seeds and the crawl log

_NORMAL = f"CASE WHEN lower({_x('base', 2)}) IN ('http','https') AND {_x('base', 4)} <> '' THEN lower({_x('base', 2)}) || '://' || {_x('base', 4)} || {_x('base', 5)} || CASE WHEN {_x('base', 7)} <> '' THEN '?' || {_x('base', 7)} ELSE '' END END"


@_query(
    f"WITH {T.SEEDS}, two AS (SELECT id * 2 + r AS ord, url, CASE WHEN id % 4 = 0 THEN NULL ELSE 'g' || (id % 6) END AS identifier FROM s, range(2) t(r)), {_SCHEMED.replace('FROM s)', 'FROM two)')}, n AS (SELECT ord, {_NORMAL} AS url, identifier FROM w) "
    "SELECT url, identifier, min(ord) AS ord FROM n WHERE url IS NOT NULL GROUP BY url, identifier"
)
def q_seed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.seeds import deduplicated

    k = F.col("id")
    twice = T.seed_texts(spark, sf_dir).select(F.explode(F.array(k * 2, k * 2 + 1)).alias("ord"), "url", F.when(k % 4 != 0, F.concat(F.lit("g"), (k % 6).cast("string"))).alias("identifier"))
    return deduplicated(twice.withColumn("url", U.normalize_source_url("url")).where("url is not null"))


@_query(f"WITH {T.LOG} SELECT ord, url, session_date FROM ov WHERE session_date >= '2024-01-05' AND session_date <= '2024-01-20' AND status = '200'")
def q_success_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.success_window(T.crawl_log(spark, sf_dir), "2024-01-05", "2024-01-20").select("ord", "url", "session_date")


@_query(f"WITH {T.LOG}, last AS (SELECT max(session_date) AS today FROM ov), done AS (SELECT DISTINCT regexp_replace(url, '(https?://)?(www\\.)?', '', 'g') AS k FROM ov WHERE level = 0 AND status = '200' AND session_date > '2024-01-29'), seeds AS (SELECT DISTINCT 'http://www.' || substr(url, 9) AS url FROM ov) SELECT url FROM seeds WHERE regexp_replace(url, '(https?://)?(www\\.)?', '', 'g') NOT IN (SELECT k FROM done)")
def q_skip_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.crawl_log(spark, sf_dir)
    seeds = log.select(F.concat(F.lit("http://www."), F.expr("substr(url, 9)")).alias("url")).distinct()
    return O.skip_recent(seeds, log, "2024-01-31", 2)


_FLAGS = "coalesce(CAST(trunc(TRY_CAST(trim(status) AS DOUBLE)) AS INTEGER) = 200, false)"


@_query(
    f"WITH {T.LOG}, f AS (SELECT *, {_FLAGS} AS ok, lower(trim(status)) IN ('dns lookup failed','website not found','website not found in __test_domain_robots') AS gone, regexp_replace(url, '(https?://)?(www\\.)?', '', 'g') AS k FROM ov WHERE level = 0 AND session_date = '2024-01-10'), "
    "g AS (SELECT k, bool_or(ok) AS done, bool_or(NOT ok AND NOT gone) AS retry, arg_min(url, ord) AS url, arg_min(identifier, ord) AS identifier FROM f GROUP BY k) SELECT url, identifier FROM g WHERE NOT done AND retry"
)
def q_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.complement(T.crawl_log(spark, sf_dir), "2024-01-10")


@_query(f"WITH {T.LOG} SELECT domain, url, session_date, status, min(ord) AS ord FROM ov GROUP BY ALL")
def q_overview_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.deduplicated(T.crawl_log(spark, sf_dir)).select("domain", "url", "session_date", "status", "ord")


@_query(f"WITH {T.LOG}, old AS (SELECT * FROM ov WHERE session_date < '2024-01-15'), new AS (SELECT * FROM ov WHERE session_date >= '2024-01-10') SELECT url, session_date, status, min(ord) AS ord FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.domain = new.domain AND old.url = new.url AND old.session_date = new.session_date AND old.status = new.status) GROUP BY ALL")
def q_idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.crawl_log(spark, sf_dir)
    return O.new_rows(log.where("session_date >= '2024-01-10'"), log.where("session_date < '2024-01-15'")).select("url", "session_date", "status", "ord")


_STATUSES = "st AS (SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 0 THEN '200' WHEN 1 THEN ' 200.7 ' WHEN 2 THEN '404' WHEN 3 THEN 'Website not found' WHEN 4 THEN '' WHEN 5 THEN 'DNS lookup failed' WHEN 6 THEN 'Read timed out' ELSE 'Cannot connect to host x' END AS status FROM supplier)"


@_query(
    f"WITH {_STATUSES} SELECT id, {_FLAGS} AS success, lower(trim(status)) IN ('dns lookup failed','website not found','website not found in __test_domain_robots') AS gone, CAST(trunc(TRY_CAST(trim(status) AS DOUBLE)) AS INTEGER) AS code, "
    "CASE WHEN contains(lower(status), 'timed out') THEN 'Request timeout' WHEN contains(lower(status), 'name or service not known') OR contains(lower(status), 'nodename nor servname') THEN 'DNS lookup failed' WHEN contains(lower(status), 'cannot connect to host') THEN 'Connection failed' ELSE 'Request failed' END AS phrase FROM st"
)
def q_status_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.when(k % 8 == 0, "200").when(k % 8 == 1, " 200.7 ").when(k % 8 == 2, "404").when(k % 8 == 3, "Website not found").when(k % 8 == 4, "").when(k % 8 == 5, "DNS lookup failed").when(k % 8 == 6, "Read timed out").otherwise("Cannot connect to host x")
    rows = T.table(spark, sf_dir, "supplier").select(k.alias("id"), status.alias("status"))
    return rows.select("id", S.status_is_success("status").alias("success"), S.status_is_not_found("status").alias("gone"), S.status_code("status").alias("code"), S.exception_status("status").alias("phrase"))


@_query(
    f"""WITH {T.LOG}, a AS (SELECT user_id, list({{'st': CASE WHEN event_id % 5 = 0 THEN '429' WHEN event_id % 7 = 0 THEN '403' ELSE status END, 'ra': CASE WHEN event_id % 10 = 0 THEN 7.0::DOUBLE END}} ORDER BY event_id) AS l FROM events JOIN ov ON ov.ord = events.event_id GROUP BY user_id),
r AS (WITH RECURSIVE f(user_id, i, n, wait, l) AS (SELECT user_id, 0, len(l), 0.0::DOUBLE, l FROM a UNION ALL SELECT user_id, i + 1, n, least(30.0::DOUBLE, CASE WHEN l[i+1].st = '429' THEN CASE WHEN l[i+1].ra IS NOT NULL THEN greatest(l[i+1].ra, 0.0::DOUBLE) ELSE greatest(6.0::DOUBLE, wait * 2) END WHEN l[i+1].st = '403' THEN greatest(3.0::DOUBLE, wait * 1.6::DOUBLE + 0.25::DOUBLE)
 WHEN TRY_CAST(l[i+1].st AS DOUBLE) >= 500 THEN greatest(1.5::DOUBLE, wait * 1.3::DOUBLE + 0.15::DOUBLE) WHEN contains(lower(l[i+1].st), 'timeout') OR contains(lower(l[i+1].st), 'dns lookup failed') THEN greatest(1.5::DOUBLE, wait * 1.2::DOUBLE + 0.1::DOUBLE) ELSE wait * 0.85::DOUBLE END), l FROM f WHERE i < n) SELECT user_id, n, wait FROM f WHERE i = n)
SELECT user_id, CAST(n AS BIGINT) AS attempts, round(wait, 6) AS wait FROM r"""
)
def q_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.crawl_log(spark, sf_dir).select("ord", F.col("status").alias("st0"))
    k = F.col("event_id")
    rows = T.table(spark, sf_dir, "events").join(log, F.col("ord") == k).select("user_id", "event_id", F.when(k % 5 == 0, "429").when(k % 7 == 0, "403").otherwise(F.col("st0")).alias("status"), F.when(k % 10 == 0, 7.0).alias("retry_after"))
    attempts = F.array_sort(F.collect_list(F.struct("event_id", "status", "retry_after")))
    return rows.groupBy("user_id").agg(attempts.alias("a")).select("user_id", F.size("a").cast("long").alias("attempts"), F.round(S.wait_after("a"), 6).alias("wait"))


@_query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN CAST(s_suppkey AS DOUBLE) WHEN 1 THEN 45.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE END AS seconds FROM supplier")
def q_retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "Wed, 31 Jan 2024 10:00:45 GMT").when(k % 4 == 2, "Mon, 01 Jan 2024 00:00:00 GMT").when(k % 8 == 3, "soon")
    return T.table(spark, sf_dir, "supplier").select(k.alias("id"), S.retry_after_seconds(text, F.lit("2024-01-31 10:00:00")).alias("seconds"))


# --- pages

_ANCHORS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
_LINKS = f"l AS (SELECT url AS src_url, CAST(unnest(range(len({_ANCHORS}))) AS INTEGER) AS pos, unnest({_ANCHORS}) AS href FROM pages), g AS (SELECT *, lower({_x('src_url', 2)}) || '://' || {_x('src_url', 4)} || href AS dst_url FROM l)"


@_query(f"WITH {_LINKS} SELECT src_url, pos, href, dst_url FROM g")
def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edges(T.table(spark, sf_dir, "pages"))


@_query(f"WITH {_LINKS}, o AS (SELECT src_url, pos, CASE WHEN pos % 2 = 0 THEN dst_url || '?a=1#b' ELSE 'http://other.example.org/x' END AS dst_url FROM g), {_sql_domains('o', 'dst_url').replace('dom AS', 'd1 AS').replace('h AS', 'h AS')}, d2 AS (SELECT src_url, pos, dst_url, registered AS dst_domain FROM d1), {_sql_domains('d2', 'src_url').replace('h AS', 'k AS').replace('FROM h)', 'FROM k)').replace('h2', 'k2').replace('h3', 'k3').replace('h4', 'k4')} SELECT src_url, pos, regexp_replace(dst_url, '(?s)[?#].*$', '') AS dst_url FROM dom WHERE dst_domain = registered")
def q_links_within_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.edges(T.table(spark, sf_dir, "pages"))
    mixed = e.select("src_url", "pos", F.when(F.col("pos") % 2 == 0, F.concat("dst_url", F.lit("?a=1#b"))).otherwise("http://other.example.org/x").alias("dst_url"))
    return L.within_domain(mixed, rules=SUFFIXES)


@_query(f"WITH {_LINKS} SELECT dst_url, count(*) AS links, count(DISTINCT src_url) AS pages FROM g GROUP BY dst_url")
def q_link_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edges(T.table(spark, sf_dir, "pages")).groupBy("dst_url").agg(F.count("*").alias("links"), F.countDistinct("src_url").alias("pages"))


_META = list(enumerate(sorted(X.META_NAMES)))
_META_ROWS = ", ".join(f"({i}, '{name}')" for i, name in _META)


@_query(
    f"""WITH n(i, name) AS (VALUES {_META_ROWS}), m AS (SELECT page_id, 'meta_encoding' AS k, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS v FROM pages
UNION ALL SELECT page_id, 'meta_' || name, CASE WHEN i = 0 THEN 'last' ELSE 'é' || i || '-' || page_id END FROM pages, n WHERE (i = 0 OR (page_id + i) % 3 <> 0) AND NOT (name = 'encoding' AND contains(html, '<meta charset="')))
SELECT page_id, string_agg(k || '=' || v, ';' ORDER BY k) AS meta FROM m WHERE v <> '' GROUP BY page_id"""
)
def q_meta_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with about two thirds of the known tags in front, an unknown one, and one that comes twice."""
    k = F.col("page_id")
    tags = [F.when((k + i) % 3 != 0, F.concat(F.lit(f'<meta {"property" if i % 2 else "name"}="{name}" content="&eacute;{i}-'), k.cast("string"), F.lit('"/>'))).otherwise("") for i, name in _META]
    html = F.concat(*tags, F.lit(f'<meta name="unknown" content="x"><meta name="{_META[1][1]}"><META NAME="{_META[0][1]}" content="last">'), "html")
    t = E.tokenized(T.table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")), {})
    return t.select("page_id", F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("meta"))


_PLAIN = r"""s1 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', chr(1), 'g'), '(?s)<style>.*?</style>', chr(1), 'g'), '(?s)<!--.*?-->', chr(1), 'g') AS h FROM pages),
s2 AS (SELECT page_id, string_split(regexp_replace(h, '<[^>]*>', chr(1), 'g'), chr(1)) AS parts FROM s1),
s3 AS (SELECT page_id, [replace(replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') FOR x IN parts] AS parts FROM s2),
s4 AS (SELECT page_id, [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN parts] AS parts FROM s3)"""


@_query(f"WITH {_PLAIN} SELECT page_id, array_to_string([x FOR x IN parts IF x <> ''], chr(10)) AS text FROM s4")
def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tokenized(T.table(spark, sf_dir, "pages").select("page_id", "url", "html"), {}).select("page_id", F.col("raw_text").alias("text"))


def _nfkd_sql(text: str) -> str:
    """The compatibility form of a text, letter by letter of the Latin blocks and some signs; DuckDB has no function for it."""
    for c in map(chr, [*range(0xA0, 0x250), 0x2026, 0x2122, *range(0xFB00, 0xFB05)]):
        plain = unicodedata.normalize("NFKD", c)
        if plain != c:
            text = f"replace({text}, '{c}', '{plain}')"
    return text


_PAGE_TEXT = "array_to_string([x FOR x IN parts IF x <> ''], chr(10))"


@_query(lambda: f"WITH {_PLAIN} SELECT page_id, {_nfkd_sql(_PAGE_TEXT)} AS text FROM s4")
def q_page_text_nfkd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tokenized(T.table(spark, sf_dir, "pages").select("page_id", "url", "html"), {}).select("page_id", F.col("html_text").alias("text"))


# --- fields

_ZIPS = r"list_filter(list_distinct(regexp_extract_all(txt, '\b(?:NL-)?[0-9]{4}\s?[A-Z]{2}\b')), lambda z: right(z, 2) NOT IN ('SA','SD','SS'))"


@_query(f"WITH {T.CONTACTS} SELECT id, unnest({_ZIPS}) AS zipcode FROM t")
def q_zipcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.contact_text(spark, sf_dir).select("id", F.explode(X.zipcodes("txt")).alias("zipcode"))


@_query(
    rf"WITH {T.CONTACTS}, z AS (SELECT id, txt, unnest({_ZIPS}) AS z FROM t), b AS (SELECT id, regexp_replace(right(substr(txt, 1, instr(txt, z) - 1), 100), '\s+$', '') AS before FROM z), "
    r"n AS (SELECT id, string_split(before, chr(10)) AS l FROM b), p AS (SELECT id, regexp_replace(CASE WHEN length(l[-1]) < 5 AND len(l) > 1 THEN l[-2] ELSE l[-1] END, '^\s+|\s+$', '', 'g') AS line FROM n), "
    r"m AS (SELECT id, [regexp_replace(regexp_replace(x, '(?i)\b(?:te|aan|gevestigd)\b', '', 'g'), '^\s+|\s+$', '', 'g') FOR x IN regexp_extract_all(line, '\b([- a-zA-ZÀ-ÿ]+\s+[-_\s0-9A-Za-z]{1,9})[-,|\s]{0,5}', 1)] AS f FROM p) "
    "SELECT id, [x FOR x IN f IF x <> ''][-1] AS address FROM m WHERE len([x FOR x IN f IF x <> '']) > 0"
)
def q_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.contact_text(spark, sf_dir).withColumn("z", X.zipcodes("txt"))
    return rows.select("id", F.explode(X.addresses("txt", "z")).alias("address"))


def _field_sql(pattern: str, group: int, name: str, keep: str = "") -> str:
    return rf"WITH {T.CONTACTS} SELECT DISTINCT id, {name} FROM (SELECT id, unnest(regexp_extract_all(txt, '{pattern}', {group})) AS {name} FROM t){keep}"


@_query(_field_sql(r'(?is)t(?:el(?:efoon)?:|[.:\s])[/;|&bnps\s]{0,4}(["+|]?[-()|\s0-9]{9,15})\b', 1, "phone"))
def q_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.contact_text(spark, sf_dir).select("id", F.explode(X.phones("txt")).alias("phone"))


@_query(_field_sql(r"([-+._0-9A-Za-z]+@[-._0-9A-Za-z]{1,25}\.[-A-Za-z]{1,7})", 1, "email", " WHERE lower(string_split(email, '.')[-1]) <> 'png'"))
def q_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.contact_text(spark, sf_dir).select("id", F.explode(X.emails("txt")).alias("email"))


@_query(rf"WITH {T.CONTACTS} SELECT DISTINCT id, regexp_replace(f, '^\s+|\s+$', '', 'g') AS fax FROM (SELECT id, unnest(regexp_extract_all(txt, '(?is)\bf(?:ax(?:number)?)?\b[^+0-9]{{0,12}}(\+?[0-9][-()\s0-9]{{7,20}})\b', 1)) AS f FROM t)")
def q_fax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.contact_text(spark, sf_dir).select("id", F.explode(X.faxes("txt")).alias("fax"))


@_query(_field_sql(r"(?is)k\.?v\.?k.{0,40}?(\b[0-9]{8}\b)", 1, "kvk"))
def q_kvk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.contact_text(spark, sf_dir).select("id", F.explode(X.kvk_numbers("txt")).alias("kvk"))


@_query(_field_sql(r"(?is)(btw|vat)(.{1,20})(\bNL\s*[-._0-9]{9,12}\s*[ .0-9B]{0,5}|\bNL\b[-._0-9B]+)", 3, "btw"))
def q_btw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.contact_text(spark, sf_dir).select("id", F.explode(X.vat_numbers("txt")).alias("btw"))


@_query(
    "WITH h AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN '/docs/annual-report-' || page_id || '.pdf' WHEN 1 THEN 'https://x.example.com/Jaarverslag' WHEN 2 THEN '/privacy/annual-report' WHEN 3 THEN 'investor/' || page_id ELSE '/about' END AS href FROM pages) "
    f"SELECT page_id, CASE WHEN starts_with(href, '/') THEN lower({_x('url', 2)}) || '://' || {_x('url', 4)} || href ELSE href END AS report FROM h WHERE page_id % 5 IN (0, 1, 3)"
)
def q_annual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    n = k.cast("string")
    href = F.when(k % 5 == 0, F.concat(F.lit("/docs/annual-report-"), n, F.lit(".pdf"))).when(k % 5 == 1, "https://x.example.com/Jaarverslag").when(k % 5 == 2, "/privacy/annual-report").when(k % 5 == 3, F.concat(F.lit("investor/"), n)).otherwise("/about")
    return T.table(spark, sf_dir, "pages").select("page_id", F.explode(X.report_links(F.array(href), "url")).alias("report"))


_SHOP = "<html><head><title>Shop</title><style>p{}</style></head><body><!-- no --><p>", "</p></body></html>"


def _shop_sql() -> str:
    """The field queries, over pages' text or source instead of plain texts."""
    text = f"{T.CONTACTS.replace('t AS', 'plain AS', 1)}, t AS (SELECT id, 'Shop' || chr(10) || txt AS txt FROM plain)"
    source = f"{T.CONTACTS.replace('t AS', 'plain AS', 1)}, t AS (SELECT id, '{_SHOP[0]}' || replace(txt, chr(10), '</p><p>') || '{_SHOP[1]}' AS txt FROM plain)"
    of = {"zipcode": ("q_zipcodes", text), "address": ("q_address", text), "kvk": ("q_kvk", text), "btw": ("q_btw", text), "phone": ("q_phone", source), "email": ("q_email", source), "fax": ("q_fax", source)}
    return " UNION ALL ".join(f"SELECT id, '{f}' AS field, {f} AS value FROM ({_SQL[q].replace(T.CONTACTS, where)})" for f, (q, where) in of.items())


@_query(_shop_sql)
def q_contact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of pages made of the customers' texts, through the page reader."""
    html = F.concat(F.lit(_SHOP[0]), F.replace("txt", F.lit("\n"), F.lit("</p><p>")), F.lit(_SHOP[1]))
    pages = T.contact_text(spark, sf_dir).select(F.lit("example.com").alias("domain"), F.col("id").cast("string").alias("identifier"), F.lit(0).alias("level"), F.lit("https://example.com/").alias("url"), F.lit("2024-01-31").alias("session_date"), F.lit("x").alias("path"), html.alias("html"))
    found = E.extract(pages, E.contact_fields())
    named = lambda f: F.transform(f, lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))
    rows = found.select(F.col("identifier").cast("long").alias("id"), F.explode(F.flatten(F.array(*map(named, C.FIELDS)))).alias("p"))
    return rows.select("id", "p.field", "p.value")


# --- consolidation

_CLEAN = f"{T.RECORDS}, {_sql_domains('pg', 'domain')}, cp AS (SELECT clean AS domain, identifier, text, ord, zipcode, phone, email FROM dom)"
_COUNTS = "fc AS (SELECT domain, field, value, count(*) AS count FROM (SELECT domain, 'zipcode' AS field, unnest(zipcode) AS value FROM cp UNION ALL SELECT domain, 'phone', unnest(phone) FROM cp UNION ALL SELECT domain, 'email', unnest(email) FROM cp) GROUP BY ALL)"


@_query(f"WITH {_CLEAN}, {_COUNTS} SELECT domain, field, value, count FROM fc")
def q_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.field_counts(C.with_clean_domain(T.page_records(spark, sf_dir), SUFFIXES))


def _flat(df: DataFrame) -> DataFrame:
    entries = lambda f: F.array_join(F.transform(F.array_sort(F.map_entries(f)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return df.select("domain", "identifier", *(entries(f).alias(f) for f in ("zipcode", "phone", "email")), "text")


def _consolidated_sql(text: str) -> str:
    one = lambda f: f"coalesce((SELECT string_agg(value || '=' || count, ';' ORDER BY value) FROM fc WHERE fc.domain = x.domain AND field = '{f}'), '') AS {f}"
    return f"WITH {_CLEAN}, {_COUNTS}, x AS (SELECT domain, arg_min(identifier, ord) AS identifier FROM cp GROUP BY domain), {text} SELECT x.domain, identifier, {one('zipcode')}, {one('phone')}, {one('email')}, text FROM x JOIN tx ON tx.domain = x.domain"


@_query(_consolidated_sql("tx AS (SELECT domain, ' ' || string_agg(coalesce(text, ''), ' ' ORDER BY ord) AS text FROM cp GROUP BY domain)"))
def q_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(C.consolidated(T.page_records(spark, sf_dir), rules=SUFFIXES))


@_query(_consolidated_sql("nb AS (SELECT *, (row_number() OVER (ORDER BY ord) - 1) // 100 AS chunk FROM cp), ch AS (SELECT domain, chunk, ' ' || string_agg(coalesce(text, ''), ' ' ORDER BY ord) AS text FROM nb GROUP BY ALL), tx AS (SELECT domain, string_agg(text, ' ' ORDER BY chunk) AS text FROM ch GROUP BY domain)"))
def q_consolidated_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(C.consolidated(T.page_records(spark, sf_dir), chunk_size=100, rules=SUFFIXES))


@_query(f"WITH {_CLEAN}, {_COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY count DESC, value) AS n FROM fc WHERE field = 'zipcode') SELECT domain, value, count FROM r WHERE n = 1")
def q_main_zipcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.main_value(C.with_clean_domain(T.page_records(spark, sf_dir), SUFFIXES))


# --- crawling


def _level_sql(k: int, budget: int | None = None) -> str:
    seen = " UNION ALL ".join(f"SELECT seed, url FROM l{i}" for i in range(k))
    quota = f" JOIN (SELECT seed, count(*) AS used FROM ({seen}) GROUP BY seed) u USING (seed) WHERE used < {budget} AND rank <= {budget} - used + 1" if budget else ""
    return f"""c{k} AS (SELECT l.seed, dst_url AS url, min(l.rank * 1000000000 + pos) AS place FROM l{k - 1} l JOIN e ON e.src_url = l.url WHERE NOT EXISTS (SELECT 1 FROM ({seen}) o WHERE o.seed = l.seed AND o.url = dst_url) GROUP BY ALL),
r{k} AS (SELECT seed, url, row_number() OVER (PARTITION BY seed ORDER BY place) AS rank FROM c{k}), l{k} AS (SELECT r{k}.seed, url, rank FROM r{k}{quota})"""


def _bfs_sql(budget: int | None = None) -> str:
    start = "l0 AS (SELECT s_suppkey AS seed, 'https://www.example.com/n' || s_suppkey AS url, CAST(0 AS BIGINT) AS rank FROM supplier)"
    return f"WITH {T.EDGES}, {start}, {_level_sql(1, budget)}, {_level_sql(2, budget)} " + " UNION ALL ".join(f"SELECT {k} AS level, seed, url, rank FROM l{k}" for k in range(3))


def _bfs(spark: SparkSession, sf_dir: str, budget: int | None = None) -> DataFrame:
    n = F.col("s_suppkey")
    seeds = T.table(spark, sf_dir, "supplier").select(n.alias("seed"), F.concat(F.lit("https://www.example.com/n"), n.cast("string")).alias("url"))
    return B.bfs(seeds, T.link_graph(spark, sf_dir), 3, budget).select("level", "seed", "url", "rank")


@_query(_bfs_sql())
def q_bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bfs(spark, sf_dir)


@_query(_bfs_sql(50))
def q_bfs_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bfs(spark, sf_dir, 50)


_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/  # most\nAllow: /en/1*5\nDisallow: /*.html$\nAllow: /en/1*7.html$\n"


@_query(
    f"""WITH p AS (SELECT page_id, {_x('url', 5)} || CASE WHEN {_x('url', 7)} <> '' THEN '?' || {_x('url', 7)} ELSE '' END AS target FROM pages), r AS (SELECT * FROM (VALUES (false, 4, '^/en/'), (true, 7, '^/en/1.*5'), (false, 8, '^/.*\\.html$'), (true, 13, '^/en/1.*7\\.html$')) v(allow, n, re)),
m AS (SELECT page_id, arg_max(allow, n * 2 + allow::INT) AS allow FROM p JOIN r ON regexp_matches(target, re) GROUP BY page_id) SELECT page_id, coalesce(allow, true) AS allowed FROM p LEFT JOIN m USING (page_id)"""
)
def q_robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.table(spark, sf_dir, "pages").select("page_id", U.authority("url").alias("host"), F.concat(U.path("url"), F.when(U.query("url") != "", F.concat(F.lit("?"), U.query("url"))).otherwise("")).alias("target"))
    rules = R.parse_robots(pages.select("host", F.lit(_ROBOTS).alias("body")).distinct())
    return R.allowed(pages, rules).select("page_id", "allowed")


def _tagged_domains(source: str, url: str, tag: str) -> str:
    """_sql_domains() with other names of its CTEs; the last one is dom_<tag>."""
    out = _sql_domains(source, url)
    for name in ("h4", "h3", "h2", "h", "dom"):
        out = re.sub(rf"(?m)^{name} AS|(?<=FROM ){name}(?=[) ]|$)", lambda m, n=name: m[0].replace(n, f"{n}_{tag}"), out)
    return out


def _key(x: str) -> str:
    return f"regexp_replace({x}, '(https?://)?(www\\.)?', '', 'g')"


def _crawl_level(k: int) -> str:
    """Level k of every seed: links of the level before, budget, classification."""
    seen = " UNION ALL ".join(f"SELECT seed, key FROM v{i}" for i in range(k))
    used = " UNION ALL ".join(f"SELECT seed FROM v{i}" for i in range(k))
    path, ext = _x("url", 5), f"lower(regexp_extract(regexp_extract({_x('url', 5)}, '([^/]+)/*$', 1), '^.+\\.([^.]+)$', 1))"
    rule = f"NOT regexp_matches({path}, '^[^a-zA-Z]+$')" if k == 1 else f"regexp_matches({path}, '{_RULES.positive}')"
    return f"""f{k} AS (SELECT v.seed, v.identifier, v.site, v.rank, s.pos, lower({_x('v.url', 2)}) || '://' || {_x('v.url', 4)} || s.href AS dst FROM v{k - 1} v JOIN links s ON s.key = v.key WHERE v.followed),
{_tagged_domains(f'f{k}', 'dst', f'l{k}')},
n{k} AS (SELECT seed, identifier, site, regexp_replace(dst, '(?s)[?#].*$', '') AS url, {_key("regexp_replace(dst, '(?s)[?#].*$', '')")} AS key, rank * 1000000000 + pos AS place FROM dom_l{k} WHERE registered = site),
g{k} AS (SELECT seed, identifier, site, key, arg_min(url, place) AS url, min(place) AS place FROM n{k} WHERE NOT EXISTS (SELECT 1 FROM ({seen}) o WHERE o.seed = n{k}.seed AND o.key = n{k}.key) GROUP BY ALL),
r{k} AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY place) AS rank FROM g{k}),
u{k} AS (SELECT seed, count(*) AS used FROM ({used}) GROUP BY seed),
v{k} AS (SELECT r.seed, identifier, site, url, key, rank, {k} AS level, CASE WHEN regexp_matches(url, '(?i)^(mailto|tel):') THEN false WHEN {ext} IN ('jpeg','jpg','pdf','png') THEN false WHEN regexp_matches({path}, '{_RULES.negative}') THEN false ELSE {rule} END AS followed FROM r{k} r JOIN u{k} USING (seed) WHERE used < 50 AND rank <= 50 - used + 1)"""


@_query(
    f"""WITH {_tagged_domains('pages', 'url', 's')}, store AS (SELECT {_key('url')} AS key, min({{'url': url, 'digest': md5(coalesce(html, '')), 'html': html}}) AS p FROM pages GROUP BY key),
links AS (SELECT key, CAST(unnest(range(len({_ANCHORS.replace('html', 'p.html')}))) AS INTEGER) AS pos, unnest({_ANCHORS.replace('html', 'p.html')}) AS href FROM store),
v0 AS (SELECT DISTINCT url AS seed, registered AS identifier, registered AS site, url, {_key('url')} AS key, 0 AS rank, 0 AS level, true AS followed FROM dom_s),
{_crawl_level(1)},
{_crawl_level(2)},
v AS (SELECT seed, identifier, site, url, key, rank, level FROM v0 WHERE followed UNION ALL SELECT seed, identifier, site, url, key, rank, level FROM v1 WHERE followed UNION ALL SELECT seed, identifier, site, url, key, rank, level FROM v2 WHERE followed),
a AS (SELECT v.*, CASE WHEN s.key IS NULL THEN '404' ELSE '200' END AS status FROM v LEFT JOIN store s ON s.key = v.key)
SELECT site AS domain, identifier, CAST(level AS INTEGER) AS level, CAST(rank AS BIGINT) AS rank, url, status, '2024-01-31' AS session_date, '2024-01-31 00:00:00' AS crawl_date,
 CASE WHEN status = '200' THEN replace(site || '/' || regexp_replace({_x('url', 4)}, 'www\\.', '', 'g') || '/2024-01-31/' || CASE WHEN string_split(regexp_replace(url, '/$', ''), '/')[-1] = '' THEN 'index' ELSE string_split(regexp_replace(url, '/$', ''), '/')[-1] END, ' ', '_') END AS path FROM a"""
)
def q_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of the page store from its own pages."""
    pages = T.table(spark, sf_dir, "pages")
    return B.crawl(pages.select("url", F.lit(None).cast("string").alias("identifier")), pages, "2024-01-31", B.CrawlConfig(suffixes=SUFFIXES)).drop("seed")


def _as_fetched(pages: DataFrame) -> DataFrame:
    return pages.select(D.registered_domain("url", SUFFIXES).alias("domain"), F.col("page_id").cast("string").alias("identifier"), F.lit(0).alias("level"), "url", F.lit("2024-01-31").alias("session_date"), F.lit("x").alias("path"), "html")


def _plugin_sql() -> str:
    mails = r"list_sort(list_distinct([e FOR e IN regexp_extract_all(html, '([-+._0-9A-Za-z]+@[-._0-9A-Za-z]{1,25}\.[-A-Za-z]{1,7})', 1) IF NOT list_contains(" + _list(X.FILE_ENDINGS) + ", lower(string_split(e, '.')[-1]))]))"
    return f"""WITH {_PLAIN}, {_tagged_domains('pages', 'url', 'x')}
SELECT registered AS domain, CAST(page_id AS VARCHAR) AS identifier, url AS website, 'x' AS path, '{{"meta_encoding":"' || regexp_extract(html, '<meta charset="([^"]*)"', 1) || '"}}' AS meta, array_to_string({mails}, ' ') AS email, CAST(len({_ANCHORS}) AS VARCHAR) AS links, {_nfkd_sql(_PAGE_TEXT)} AS text
FROM dom_x JOIN s4 USING (page_id)"""


@_query(_plugin_sql)
def q_extract_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with contact fields and a plug-in that counts links."""
    extra = E.contact_fields()
    extra.register_field("links", lambda page: [str(len(page.hrefs))])
    r = E.extract(_as_fetched(T.table(spark, sf_dir, "pages")), extra)
    return r.select("domain", "identifier", "website", "path", F.to_json("meta").alias("meta"), F.array_join(F.array_sort("email"), " ").alias("email"), F.array_join("links", " ").alias("links"), "text")


@_query("SELECT CAST(page_id AS VARCHAR) AS identifier, CASE WHEN page_id % 10 = 0 THEN 'Error extracting' ELSE 'x' END AS path FROM pages")
def q_extract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plug-in that fails on every tenth page spoils just those records."""
    extra = E.Fields()
    rows = _as_fetched(T.table(spark, sf_dir, "pages")).withColumn("html", F.when(F.col("identifier").cast("long") % 10 == 0, F.concat(F.lit("<p>broken</p>"), "html")).otherwise(F.col("html")))

    def fails(page):
        if page.html.startswith("<p>broken</p>"):
            raise ValueError("broken")
        return []

    extra.register_field("probe", fails)
    return E.extract(rows, extra).select("identifier", "path")


@_query("SELECT page_id, octet_length(encode(html)) AS bytes, md5(html) AS digest FROM pages")
def q_zip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives by domain, read again, and joined to their log rows."""
    from ..sources import archive

    pages = T.table(spark, sf_dir, "pages").withColumn("member", F.concat(F.col("page_id").cast("string"), F.lit("/index")))
    path = new_path(spark, "pages")
    archive.write_archives(pages.select(F.regexp_replace(U.authority("url"), r"www\.", "").alias("zip_name"), "member", F.col("html").cast("binary").alias("content")), path)
    back = archive.read_archives(spark, path)
    return back.select(F.split("member", "/")[0].cast("long").alias("page_id"), F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


@_query(f"WITH {T.LOG} SELECT session_date, status, count(*) AS n, count(DISTINCT url) AS urls FROM ov GROUP BY ALL")
def q_crawl_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.crawl_log(spark, sf_dir).groupBy("session_date", "status").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


# --- streams


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a pattern, as streams take no single file for a path
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once all that is there has been read, from a table in the shared folder."""

    spark = stream.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@_query(f"WITH {T.LOG} SELECT date_trunc('hour', CAST(crawl_date AS TIMESTAMP)) AS hour, status, count(*) AS pages FROM ov GROUP BY ALL")
def q_stream_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.log_of(_events_stream(spark, sf_dir)).withColumn("crawl_ts", F.try_to_timestamp("crawl_date", F.lit("yyyy-MM-dd HH:mm:ss")))
    return _finished(W.status_counts(log), "complete").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "status", "pages")


@_query(f"WITH {T.LOG} SELECT DISTINCT domain, url, session_date, status FROM ov")
def q_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.log_of(_events_stream(spark, sf_dir)).withColumn("crawl_ts", F.try_to_timestamp("crawl_date", F.lit("yyyy-MM-dd HH:mm:ss")))
    return _finished(W.deduplicated(log), "append").select("domain", "url", "session_date", "status")


@_query(_SQL["q_backoff"].replace("SELECT user_id, CAST(n AS BIGINT) AS attempts, round(wait, 6) AS wait FROM r", "SELECT CAST(user_id AS VARCHAR) AS domain, round(wait, 6) AS wait FROM r"))
def q_stream_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = T.log_of(_events_stream(spark, sf_dir), "user_id"), F.col("ord")
    rows = e.select(F.col("user_id").cast("string").alias("domain"), F.timestamp_seconds(k).alias("crawl_ts"), "ord", F.when(k % 5 == 0, "429").when(k % 7 == 0, "403").otherwise(F.col("status")).alias("status"), F.when(k % 10 == 0, 7.0).alias("retry_after"))
    return _finished(W.waits(rows), "update").select("domain", F.round("wait", 6).alias("wait"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, sql in _SQL.items()}
