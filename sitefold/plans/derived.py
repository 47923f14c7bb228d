"""Relations that the queries run on, derived from the driver's tables: in Spark, and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a crawl log."""
    return log_of(table(spark, sf_dir, "events"))


def log_of(e: DataFrame, *more: str) -> DataFrame:
    """The log of a table or stream of events, with more of its columns."""
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "click"), "200").when(kind == "error", "500").when(kind == "signup", "Request timeout").when(kind == "purchase", "DNS lookup failed").otherwise("403")
    return e.select(
        F.lit("example.com").alias("domain"), F.concat(F.lit("id"), F.col("user_id").cast("string")).alias("identifier"), (F.col("event_id") % 4).cast("int").alias("level"),
        F.concat(F.lit("https://site"), F.col("user_id").cast("string"), F.lit(".example.com/p"), (F.col("event_id") % 5).cast("string")).alias("url"),
        status.alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("session_date"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("crawl_date"), F.col("event_id").alias("ord"), *more,
    )


LOG = """ov AS (SELECT 'example.com' AS domain, 'id' || user_id AS identifier, CAST(event_id % 4 AS INTEGER) AS level, 'https://site' || user_id || '.example.com/p' || (event_id % 5) AS url,
 CASE WHEN event_type IN ('view','click') THEN '200' WHEN event_type = 'error' THEN '500' WHEN event_type = 'signup' THEN 'Request timeout' WHEN event_type = 'purchase' THEN 'DNS lookup failed' ELSE '403' END AS status,
 strftime(ts, '%Y-%m-%d') AS session_date, strftime(ts, '%Y-%m-%d %H:%M:%S') AS crawl_date, event_id AS ord FROM events)"""


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as extracted page records: their sources are the sites."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    one = lambda a, m, b: F.array(F.concat(F.lit(a), (n % m).cast("string"), F.lit(b)))
    return d.select(
        F.concat(F.lit("www."), F.col("source"), F.lit(".example.com")).alias("host"), F.concat(F.col("source"), F.lit(".co.uk")).alias("domain"), F.concat(F.col("lang"), F.lit("-"), F.col("source")).alias("identifier"), "text", n.alias("ord"),
        one("10", 37, " AB").alias("zipcode"), one("06-1234", 11, "").alias("phone"), F.when(n % 3 == 0, one("info", 5, "@example.com")).alias("email"),
    )


RECORDS = """pg AS (SELECT 'www.' || source || '.example.com' AS host, source || '.co.uk' AS domain, lang || '-' || source AS identifier, text, doc_id AS ord,
 ['10' || (doc_id % 37) || ' AB'] AS zipcode, ['06-1234' || (doc_id % 11)] AS phone, CASE WHEN doc_id % 3 = 0 THEN ['info' || (doc_id % 5) || '@example.com'] END AS email FROM documents)"""


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as links between pages of one site: each customer is a page, and ten orders lead to another one."""
    o = table(spark, sf_dir, "orders")
    at = lambda x: F.concat(F.lit("https://www.example.com/n"), x.cast("string"))
    return o.select(at(F.col("o_custkey")).alias("src_url"), F.col("o_orderkey").alias("pos"), at(F.expr("o_orderkey div 10")).alias("dst_url"))


EDGES = "e AS (SELECT 'https://www.example.com/n' || o_custkey AS src_url, o_orderkey AS pos, 'https://www.example.com/n' || (o_orderkey // 10) AS dst_url FROM orders)"


def contact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages with contact details."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    s = lambda x: x.cast("string")
    lines = F.concat(
        F.col("c_name"), F.lit("\ngevestigd aan "), F.when(k % 5 == 0, "Korte-Straat ").otherwise("Main Street "), s(k % 200 + 1), F.lit("\n"), s(1000 + k % 9000), F.when(k % 3 == 0, "AB").when(k % 7 == 0, " SS").otherwise(" CD"),
        F.lit("\nTel: 020-"), s(1000000 + k), F.lit(" Fax "), s(2000000 + k), F.lit("0\nmail: info"), s(k), F.when(k % 4 == 0, "@shop.png").otherwise("@shop-x.example.com"), F.lit("\nKvK nummer "), s(10000000 + k),
        F.lit("\nBTW: NL"), s(100000000 + k), F.lit("B01"),
    )
    return c.select(k.alias("id"), lines.alias("txt"))


CONTACTS = r"""t AS (SELECT c_custkey AS id, c_name || chr(10) || 'gevestigd aan ' || CASE WHEN c_custkey % 5 = 0 THEN 'Korte-Straat ' ELSE 'Main Street ' END || (c_custkey % 200 + 1) || chr(10) || (1000 + c_custkey % 9000) || CASE WHEN c_custkey % 3 = 0 THEN 'AB' WHEN c_custkey % 7 = 0 THEN ' SS' ELSE ' CD' END
 || chr(10) || 'Tel: 020-' || (1000000 + c_custkey) || ' Fax ' || (2000000 + c_custkey) || '0' || chr(10) || 'mail: info' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '@shop.png' ELSE '@shop-x.example.com' END || chr(10) || 'KvK nummer ' || (10000000 + c_custkey) || chr(10) || 'BTW: NL' || (100000000 + c_custkey) || 'B01' AS txt FROM customer)"""


def seed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as seed URLs, written in many ways."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    n = k.cast("string")
    url = (
        F.when(k % 9 == 0, F.concat(F.lit("  Site"), n, F.lit(".example.com  "))).when(k % 9 == 1, F.concat(F.lit("HTTP://www.site"), n, F.lit(".example.org/a?x=1#top"))).when(k % 9 == 2, F.concat(F.lit("mailto:a"), n, F.lit("@example.com")))
        .when(k % 9 == 3, F.concat(F.lit("//site"), n, F.lit(".example.net/p"))).when(k % 9 == 4, F.concat(F.lit("ftp://site"), n, F.lit(".example.net"))).when(k % 9 == 5, F.concat(F.lit("site"), n, F.lit(".example.com:8080/x")))
        .when(k % 9 == 6, F.lit("   ")).when(k % 9 == 7, F.concat(F.lit("https://blog.site"), n, F.lit(".co.uk/#f"))).otherwise(F.concat(F.lit("Tel:0"), n))
    )
    return s.select(k.alias("id"), url.alias("url"))


SEEDS = """s AS (SELECT s_suppkey AS id, CASE s_suppkey % 9 WHEN 0 THEN '  Site' || s_suppkey || '.example.com  ' WHEN 1 THEN 'HTTP://www.site' || s_suppkey || '.example.org/a?x=1#top' WHEN 2 THEN 'mailto:a' || s_suppkey || '@example.com'
 WHEN 3 THEN '//site' || s_suppkey || '.example.net/p' WHEN 4 THEN 'ftp://site' || s_suppkey || '.example.net' WHEN 5 THEN 'site' || s_suppkey || '.example.com:8080/x' WHEN 6 THEN '   ' WHEN 7 THEN 'https://blog.site' || s_suppkey || '.co.uk/#f' ELSE 'Tel:0' || s_suppkey END AS url FROM supplier)"""
