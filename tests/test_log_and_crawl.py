import pytest
from pyspark.sql import functions as F

from sitefold.functions import robots as R
from sitefold.functions import statuses as S
from sitefold.operators import crawl as C
from sitefold.operators import links as L
from sitefold.operators import overview as O
from sitefold.sources import fetch, overview_log, seeds
from sitefold.streaming.crawl_stream import wait_step

LOG = O.SCHEMA + ", ord long"


def log(spark, rows):
    return spark.createDataFrame([("a.nl", i, level, url, status, day, f"{day} 10:00:00", "p", n) for n, (url, i, level, status, day) in enumerate(rows)], LOG)


DAY = "2024-01-10"
ROWS = [
    ("https://ok.nl", "ok", 0, "200", DAY), ("https://failed.nl", "f", 0, "500", DAY), ("https://gone.nl", "g", 0, "Website not found in __test_domain_robots", DAY),
    ("https://failed.nl/about", "f", 1, "404", DAY), ("https://again.nl", "r", 0, "500", DAY), ("http://www.again.nl", "r", 0, "200", DAY), ("https://blank.nl", "b", 0, " ", DAY),
]


def test_complement_asks_what_may_be_mended(spark):
    assert [tuple(r) for r in O.complement(log(spark, ROWS), DAY).collect()] == [("https://failed.nl", "f")]
    assert O.complement(log(spark, ROWS), "2024-01-11").count() == 0


def test_recent_successes_are_skipped(spark):
    s = spark.createDataFrame([(u,) for u in ("http://ok.nl", "https://failed.nl", "https://again.nl")], "url string")
    left = {r[0] for r in O.skip_recent(s, log(spark, ROWS), "2024-01-20", 30).collect()}
    assert left == {"https://failed.nl"}
    assert O.skip_recent(s, log(spark, ROWS), "2024-02-09", 30).count() == 3  # the day itself is out


def test_success_window_is_inclusive(spark):
    rows = log(spark, [("u", "i", 0, "200", f"2024-01-0{d}") for d in range(1, 6)] + [("u", "i", 0, "200.7", "2024-01-03")])
    assert O.success_window(rows, "2024-01-02", "2024-01-04").count() == 3


def test_append_once_or_always(spark, tmp_path):
    same = log(spark, [ROWS[0]] * 3).drop("ord")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    overview_log.append_log(same, a)
    assert overview_log.read_log(spark, a).count() == 3
    for _ in range(2):
        overview_log.append_log(same, b, once=True)
    assert overview_log.read_log(spark, b).count() == 1
    tsv = str(tmp_path / "t")
    overview_log.append_log(log(spark, ROWS).drop("ord").withColumn("identifier", F.lit(None).cast("string")), tsv, "csv")
    back = overview_log.read_log(spark, tsv, "csv")
    assert back.count() == len(ROWS) and back.where("identifier is null").count() == len(ROWS) and dict(back.dtypes)["level"] == "int"


def test_old_sessions_are_deleted(spark, tmp_path):
    for d in ("2024-01-01", "session_date=2024-01-02", "2024-02-01", "other"):
        (tmp_path / d).mkdir()
    assert overview_log.delete_sessions(spark, str(tmp_path), "2024-01-01", "2024-01-31") == ["2024-01-01", "session_date=2024-01-02"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["2024-02-01", "other"]


def test_log_domain_of_other_schemes(spark):
    rows = spark.createDataFrame([("i", 0, u, "200", DAY, DAY, "p") for u in ("https://www.a.nl/x", "tel:12", "ftp://b.nl")], "identifier string, level int, url string, status string, session_date string, crawl_date string, path string")
    assert [r.domain for r in O.rows(rows).collect()] == ["a.nl", "tel:12", "ftp://b.nl"]


def waits(spark, steps):
    return spark.createDataFrame([([(s, r) for s, r in steps],)], "a array<struct<status:string,retry_after:double>>").select(S.wait_after("a")).first()[0]


@pytest.mark.parametrize("steps", [[("429", None)], [("429", None), ("200", None)], [("429", 999.0)], [("403", None), ("503", None), ("Request timeout", None)], [("429", -1.0)], [(None, None)], [("DNS lookup failed", None), ("200", None)]])
def test_backoff_columns_and_stream_step_agree(spark, steps):
    w = 0.0
    for s, r in steps:
        w = wait_step(w, s, r)
    assert waits(spark, steps) == pytest.approx(w)


def test_backoff_values(spark):
    assert waits(spark, [("429", None)]) == 6 and waits(spark, [("429", None), ("200", None)]) == pytest.approx(5.1) and waits(spark, [("429", 999.0)]) == 30
    assert waits(spark, [("429", None), ("429", None), ("200", None), ("503", None)]) == pytest.approx(13.41)


def test_retry_after(spark):
    rows = spark.createDataFrame([("7",), ("",), (None,), ("Wed, 31 Jan 2024 10:00:45 GMT",), ("Mon, 01 Jan 2024 00:00:00 GMT",), ("soon",)], "t string")
    assert [r[0] for r in rows.select(S.retry_after_seconds("t", F.lit("2024-01-31 10:00:00"))).collect()] == [7.0, None, None, 45.0, 0.0, None]
    d = spark.createDataFrame([("2024-02-29",), ("2024-02-30",), ("x",)], "t string").select(S.iso_date("t"), S.initial_wait(F.lit(1), F.lit(False)))
    assert [r[0] is None for r in d.collect()] == [False, True, True] and d.first()[1] == 0.35


ROBOTS = "# all\nUser-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/y$\nDisallow:\nAllow: /x*z\n\nUser-agent: b\nDisallow: /\n"


def test_robots(spark):
    assert R.rules_of(ROBOTS) == [(False, "/x"), (True, "/x/y$"), (True, "/x*z")] and R.rules_of(None) == []
    rules = R.parse_robots(spark.createDataFrame([("h", ROBOTS)], "host string, body string"))
    urls = spark.createDataFrame([("h", t) for t in ("/x", "/x/y", "/x/yy", "/xqz", "/other", "/x.z(")] + [("free", "/x")], "host string, target string")
    assert [r.allowed for r in R.allowed(urls, rules).orderBy("host", "target").collect()] == [True] + [t in ("/x/y", "/xqz", "/other", "/x.z(") for t in sorted(("/x", "/x/y", "/x/yy", "/xqz", "/other", "/x.z("))]


def test_bfs_levels_budget_and_order(spark):
    s = spark.createDataFrame([(1, "http://a.nl/"), (2, "http://b.nl/")], "seed long, url string")
    e = [("http://a.nl/", 0, "http://a.nl/1"), ("http://a.nl/", 1, "http://www.a.nl/1"), ("http://a.nl/", 2, "http://a.nl/2"), ("http://a.nl/1", 0, "http://a.nl/"), ("http://a.nl/2", 0, "http://a.nl/3"), ("http://a.nl/1", 1, "http://a.nl/4"), ("http://a.nl/3", 0, "http://a.nl/5")]
    edges = spark.createDataFrame(e, "src_url string, pos int, dst_url string")
    got = [(r.seed, r.level, r.url) for r in C.bfs(s, edges).orderBy("seed", "level", "rank").collect()]
    assert got == [(1, 0, "http://a.nl/"), (1, 1, "http://a.nl/1"), (1, 1, "http://a.nl/2"), (1, 2, "http://a.nl/4"), (1, 2, "http://a.nl/3"), (2, 0, "http://b.nl/")]
    few = C.bfs(s, edges, max_pages=2).where("seed = 1")
    assert few.count() == 3  # one more than the budget
    assert C.bfs(s, edges, max_pages=1).where("seed = 1").count() == 1


def test_crawl_over_a_store(spark):
    store = spark.createDataFrame([("https://www.a.nl/", '<a href="/contact">x</a><a href="/team#f">t</a><a href="/x.pdf">p</a><a href="https://other.nl">o</a><a>n</a>'), ("https://a.nl/contact", '<a href="/over-ons?x=1">'), ("https://a.nl/over-ons", "deep"), ("https://a.nl/team", '<a href="/jobs">')], "url string, html string")
    s = spark.createDataFrame([("www.a.nl/", None), ("https://missing.nl", "m")], "url string, identifier string")
    got = {(r.level, r.url, r.status, r.identifier) for r in C.crawl(s, store, DAY).collect()}
    assert got == {(0, "https://www.a.nl/", "200", "a.nl"), (0, "https://missing.nl", "404", "m"), (1, "https://www.a.nl/contact", "200", "a.nl"), (1, "https://www.a.nl/team", "200", "a.nl"), (2, "https://www.a.nl/over-ons", "200", "a.nl")}
    rules = R.parse_robots(spark.createDataFrame([("www.a.nl", "User-agent: *\nDisallow: /team")], "host string, body string"))
    assert not any("team" in r.url for r in C.crawl(s, store, DAY, robots=rules).collect())
    assert C.crawl(s, store, DAY, log=log(spark, [("https://a.nl/", "i", 0, "200", DAY)])).where("url like '%a.nl%'").count() == 0


def test_crawl_takes_one_page_of_a_clean_url(spark):
    """Whatever partitions the store has, the same of several pages counts, on every level and in the log."""
    rows = [("https://www.a.nl/", '<a href="/x1">'), ("http://a.nl/", '<a href="/x2">'), ("http://a.nl/", '<a href="/x3">'), ("http://a.nl/x2", ""), ("https://b.nl", "not asked for")]
    s = spark.createDataFrame([("https://a.nl/", "i")], "url string, identifier string")
    got = {tuple(sorted((r.level, r.url, r.status) for r in C.crawl(s, spark.createDataFrame(rows, "url string, html string").repartition(n), DAY, C.CrawlConfig(max_level=2)).collect())) for n in (1, 4)}
    assert len(got) == 1 and len(next(iter(got))) == 2
    store = spark.createDataFrame([("https://a.nl/", "<![foo[x]]><a href=/y1>", 200), ("https://a.nl/y1", None, 503)], "url string, html string, status int")
    assert sorted((r.url, r.status, r.path is None) for r in C.crawl(s, store, DAY).collect()) == [("https://a.nl/", "200", False), ("https://a.nl/y1", "503", True)]
    plan = C.crawl(s, store, DAY)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan


SITE = {
    "https://a.nl/robots.txt": ("200", "User-agent: *\nDisallow: /secret"), "https://a.nl": ("200", '<a href="/contact">c</a><a href="/secret">s</a><a href="/team">t</a>'), "https://a.nl/contact": ("200", "<p>1234 AB</p>"),
    "https://a.nl/team": ("503", None), "https://slow.nl": ("Request timeout", None), "https://odd.nl": ("raise", None),
}


def ask_site(url):
    status, body = SITE.get(url, ("404", None))
    if status == "raise":
        raise RuntimeError("no such thing")
    return url, status, body if status == "200" else None, None


def test_crawl_over_the_network(spark):
    s = spark.createDataFrame([("a.nl", "1"), ("https://slow.nl", "2"), ("https://odd.nl", "3"), ("https:///x", "4")], "url string, identifier string")
    net = fetch.Fetcher(ask=ask_site, sleep=lambda seconds: None)
    robots = net.robots(s)
    assert {(r.host, r.pattern) for r in robots.collect()} == {("a.nl", "/secret")}
    got = {(r.level, r.url, r.status) for r in C.crawl(s, net, DAY, robots=robots).collect()}
    assert got == {(0, "https://a.nl", "200"), (1, "https://a.nl/contact", "200"), (1, "https://a.nl/team", "503"), (0, "https://slow.nl", "Request timeout"), (0, "https://odd.nl", fetch.FAILED), (0, "https:///x", C.NO_SITE)}
    assert {r.url for r in net.pages().where("html is not null").collect()} == {"https://a.nl", "https://a.nl/contact"}
    assert O.complement(log(spark, [("https:///x", "4", 0, C.NO_SITE, DAY), ("https://slow.nl", "2", 0, "Request timeout", DAY)]), DAY).count() == 1


def test_waits_follow_a_domain_s_answers():
    answers = iter([("a", "429", None, "7"), ("b", "200", "x", None), ("c", "403", None, None), ("d", "200", "x", None)])
    pauses = []
    got = list(fetch.domain_answers(list("abcd"), lambda u: next(answers), pauses.append, level=1))
    assert [g[1] for g in got] == ["429", "200", "403", "200"] and pauses == pytest.approx([0.35, 7.0, 5.95, 5.95 * 1.6 + 0.25])
    assert fetch.seconds_of("7") == 7 and fetch.seconds_of("soon") is None and fetch.seconds_of("Mon, 01 Jan 2024 00:00:00 GMT") == 0


def test_subdomains_and_strict_hosts(spark):
    links = spark.createDataFrame([("https://blog.x.nl/a", 0, "https://blog.x.nl/b"), ("https://blog.x.nl/a", 1, "https://y.nl")], "src_url string, pos int, dst_url string")
    assert L.within_domain(links).count() == 1 and L.within_domain(links, strict_host=True).count() == 0


def test_two_identifiers_of_one_url_are_two_seeds(spark):
    store = spark.createDataFrame([("https://a.nl", "x")], "url string, html string")
    s = spark.createDataFrame([("https://a.nl", "1"), ("https://a.nl", "2")], "url string, identifier string")
    assert C.crawl(s, store, DAY).count() == 2


def test_in_memory_seeds(spark):
    df = C.in_memory_seeds(spark, ["a.nl", ("http://b.nl", "1"), ("2", "https://c.nl"), ("d.nl", " "), (), 7, ["e.nl"], "mailto:x"])
    assert [(r.url, r.identifier) for r in df.orderBy("ord").collect()] == [("https://a.nl", "a.nl"), ("http://b.nl", "1"), ("https://c.nl", "2"), ("https://d.nl", "d.nl"), ("https://e.nl", "e.nl")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("url,identifier\na.nl,1\n\nb.nl,\na.nl,1\na.nl,2\n", [("https://a.nl", "1"), ("https://b.nl", None), ("https://a.nl", "2")]),
        ("url\na.nl#x\nhttps://a.nl\nmailto:q\n", [("https://a.nl", None)]),
        (" Website ,ID\na.nl,NULL\n", [("https://a.nl", None)]),
        ("domain\tidentifier\tlevel\na.nl\t1\t0\nb.nl\t2\t1\nc.nl\t3\t\n", [("https://a.nl", "1"), ("https://c.nl", "3")]),
        ("other,thing\na.nl,1\n", [("https://a.nl", None)]),
    ],
)
def test_seed_files(spark, tmp_path, text, want):
    p = tmp_path / "seeds.csv"
    p.write_text(text)
    assert [(r.url, r.identifier) for r in seeds.read_source_urls(spark, str(p)).orderBy("ord").collect()] == want


def test_fetching_without_a_network():
    asked = []

    def ask(url, answers=("Request timeout", "Request failed", "200")):
        asked.append(url)
        return url, answers[len(asked) - 1], "x", None

    pauses = []
    (answer, errors) = fetch.attempts("u", ask, pauses.append, domain_wait=7.0)
    assert answer[1] == "200" and errors == 2 and pauses == [7.0, 7.0, 18.0]
    assert fetch.attempts("u", ask, pauses.append, errors=20)[0][1] == "One URL: Too many errors in domain"
    assert fetch.phrase_of(Exception("[Errno -2] Name or service not known")) == "DNS lookup failed" and fetch.phrase_of(TimeoutError()) == "Request timeout"
    scheme = lambda found: fetch.fetch_robots("a.nl", lambda c: (c, found[c.split(":")[0]], "body", None))
    assert scheme({"https": "200"}) == ("https", "body") and scheme({"https": "Request failed", "http": "404"}) == ("http", "") and fetch.fetch_robots("")[1] is None
