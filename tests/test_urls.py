import re
from urllib.parse import urljoin, urlsplit, urlunsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitefold.functions import domains as D
from sitefold.functions import urls as U
from sitefold.functions.rules import classify_url, create_pattern, load_rules, parse_extensions


def ask(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, url string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_seeds_are_normalised(spark):
    given_ = ["example.com", " https://a.nl/x?y=1#z ", "HTTP://A.nl/b", "mailto:x@y.z", "TEL:1", "", None, "ftp://a.nl", "//a.nl/p", "a.nl:8080/x", "https://"]
    want = ["https://example.com", "https://a.nl/x?y=1", "http://A.nl/b", None, None, None, None, None, "https://a.nl/p", None, None]
    assert ask(spark, given_, U.normalize_source_url("url")) == want
    assert ask(spark, ["a.nl/#x", "http://a.nl#x", "ftp://a.nl", "javascript:x"], U.normalize_base_url("url")) == ["https://a.nl/#x", "http://a.nl#x", "ftp://a.nl", None]


def test_identity_and_parts(spark):
    assert ask(spark, ["https://www.a.nl/www.b", "http://a.nl?u=https://www.c.nl"], U.clean_url("url")) == ["a.nl/b", "a.nl?u=c.nl"]
    assert ask(spark, ["http://a/b.PDF", "http://a/b.tar.gz/", "http://a/.htaccess", "http://a/x?y=z.png", "http://a.nl", None], U.url_extension("url")) == ["pdf", "gz", "", "", "", None]
    assert ask(spark, ["http://a/b?c#d", "http://a/b;p#d"], U.strip_query_and_fragment("url")) == ["http://a/b", "http://a/b;p"]
    assert ask(spark, ["https://www.a.nl/x/y z/", "https://a.nl/"], U.page_path(F.lit("a.nl"), "url", F.lit("2024-01-01"))) == ["a.nl/a.nl/2024-01-01/y_z", "a.nl/a.nl/2024-01-01/a.nl"]


@pytest.mark.parametrize("href", ["b", "/b", "../b", "./b/../c", "//c.nl/x", "http://d.nl/", "?q=1", "#f", "", "b/.", "b/..", "mailto:x@y"])
def test_links_resolve_like_the_standard_library(spark, href):
    page = "https://a.nl/x/y?q#f"
    rows = spark.createDataFrame([(page, href)], "p string, h string")
    site, folder = rows.select(U.resolve_link("p", "h"), U.resolve_link("p", "h", base="page")).first()
    assert site == urljoin("https://a.nl", href) or href in ("", "#f", "?q=1")
    if href not in ("", "#f"):
        assert folder == urljoin(page, href)


text = st.text(st.sampled_from("ab.:/?#w-_%~@0 "), max_size=14)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.builds(lambda s, r: s + r, st.sampled_from(["", "http://", "https://www.", "ab+c:", "//", "mailto:"]), text), min_size=20, max_size=40))
def test_splitting_agrees_with_the_standard_library(spark, urls):
    urls = [u for u in urls if "[" not in u and u == u.strip()]
    got = ask(spark, urls, F.struct(U.scheme("url"), U.authority("url"), U.path("url"), U.query("url"), U.fragment("url")))
    assert [tuple(g) for g in got] == [tuple(urlsplit(u)) for u in urls]


def model_registered(url, rules):
    host = (urlsplit(url).netloc or url).split("/")[0].split(":")[0].lower()
    labels = [x for x in host.replace("www.", "").split(".") if x]
    if labels and all(re.fullmatch("[0-9]+", x) for x in labels):
        return ".".join(labels)
    if len(labels) >= 3 and len(labels[-1]) == 2 and len(labels[-2]) <= 3:
        full = [x for x in host.split(".") if x]
        for i in range(len(full)):
            tail = ".".join(full[i:])
            if tail in rules.exceptions:
                return tail.replace("www.", "")
            if tail in rules.plain or ".".join(full[i + 1 :]) in rules.wild and i + 1 < len(full):
                return ".".join(full[i - 1 :]).replace("www.", "") if i else ".".join(labels[-2:])
    return ".".join(labels[-2:]) if len(labels) > 1 else host.replace("www.", "")


def test_registered_domains(spark):
    rules = D.SuffixRules(frozenset({"com", "co.uk", "uk", "jp", "ck"}), frozenset({"kobe.jp", "ck"}), frozenset({"city.kobe.jp", "www.ck"}))
    urls = ["http://www.shop.a.co.uk:80/x", "a.co.uk", "co.uk", "http://x.y.kobe.jp", "http://city.kobe.jp", "10.0.0.1", "localhost", "http://sub.b.com/a.b", "HTTPS://WWW.B.COM", "b..com", "http://x.b.ck", "www.www.b.com", "z.b.c.co"]
    assert ask(spark, urls, D.registered_domain("url", rules)) == [model_registered(u, rules) for u in urls]
    assert ask(spark, ["http://www.shop.a.co.uk", "http://x.y.kobe.jp", "http://a.city.kobe.jp", "nowhere.zz"], D.clean_domain("url", rules)) == ["a.co.uk", "x.y.kobe.jp", "city.kobe.jp", "nowhere.zz"]


def test_whole_suffix_list(spark, tmp_path):
    assert ask(spark, ["https://www.bbc.co.uk/news", "a.b.example.com"], D.registered_domain("url")) == ["bbc.co.uk", "example.com"]
    p = tmp_path / "list.dat"
    good = b"// ===BEGIN ICANN DOMAINS===\nzz\n// ===END ICANN DOMAINS===\n"
    assert not D.refresh_suffix_list(str(p), lambda: b"oops") and not p.exists()
    assert D.refresh_suffix_list(str(p), lambda: good) and p.read_bytes() == good
    assert not D.refresh_suffix_list(str(p), lambda: 1 / 0)
    assert D.parse_rules(good.decode() + "// ===BEGIN PRIVATE DOMAINS===\nx.zz\n").plain == {"zz"}


def test_classification(spark):
    def ok(url, level, **more):
        df = spark.createDataFrame([(url, level)], "u string, n int")
        return df.select(classify_url("u", "n", load_rules(**more))).first()[0]

    assert ok("http://a.nl/x.pdf", 0) and not ok("http://a.nl/x.pdf", 1) and not ok("http://a.nl/x.PDF", 1)
    assert ok("http://a.nl/x.pdf", 3, allowed="pdf") and not ok("http://a.nl/x.doc", 1, blocked=[".DOC, xls"])
    assert not ok("mailto:a@b.c", 1) and not ok("http://a.nl/", 1) and not ok("http://a.nl/553-504", 1) and ok("http://a.nl", 1)
    assert not ok("http://a.nl/search?q", 1) and ok("http://shop.a.nl/team", 1)
    assert ok("http://a.nl/Contact", 2) and not ok("http://a.nl/team", 2) and not ok("http://a.nl/contact", 3)
    assert create_pattern() == "(?i)$^" and create_pattern("a", ["New York "]) == "(?i)a|new.*york"
    assert parse_extensions(["PDF, .doc", 7, ""]) == {"pdf", "doc", "7"}
    assert parse_extensions(None) == set() and load_rules(allowed="png").blocked == {"pdf", "jpg", "jpeg"}


def test_reassembly_matches_the_standard_library(spark):
    urls = ["http://a.nl/x;p?q=1#f", "https://u@a.nl:8/?#", "http://a.nl?x"]
    assert ask(spark, urls, U.normalize_source_url("url")) == [urlunsplit(urlsplit(u)._replace(fragment="")) for u in urls]


def test_a_url_is_made_once_for_its_domain(spark):
    """Crawls compare the domain of each link: what makes the link's URL mustn't stand in the plan again for each use."""
    from sitefold.plans.catalogue import SUFFIXES

    links = spark.createDataFrame([("https://a.nl", "/x"), ("https://a.nl", "//www.b.co.uk/y"), ("https://a.nl", "1.2.3.4")], "p string, h string").withColumn("d", U.resolve_link("p", "h"))
    near = links.where(D.registered_domain("d", SUFFIXES) == "a.nl")
    assert near._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 25  # 34 before
    assert sorted(r.h for r in near.collect()) == ["/x", "1.2.3.4"]
    odd = ["..", "a..b.nl", ".1.2.3.4.", "www.a.co.uk", "x.y.kobe.jp", "nl", "www.nl", "127.0.0.1\n"]
    got = spark.createDataFrame([(x,) for x in odd], "u string").select(D.registered_domain(F.concat(F.lit("http://"), "u"), SUFFIXES)).collect()
    assert [r[0] for r in got] == ["..", "b.nl", "1.2.3.4", "a.co.uk", "kobe.jp", "nl", "nl", "0.1\n"]


def test_links_that_keep_their_host(spark):
    pages, hrefs = ["https://www.a.nl:8080/b/c?d#e", "HTTP://a.nl", "a.nl:x", "//a.nl/x"], ["/x", "x", "?q", "#f", "", "..", "/../x", " //b.nl/y", "http://b.nl", "mailto:x@y", "a.nl:80/x", "./x:y"]
    rows = spark.createDataFrame([(p, h) for p in pages for h in hrefs], "p string, h string")
    for base in ("site", "page"):
        got = rows.select("p", "h", U.keeps_host("p", "h").alias("keeps"), (U.authority("p") == U.authority(U.resolve_link("p", "h", base))).alias("same")).collect()
        assert all(r.same for r in got if r.keeps)
        assert {r.h for r in got if r.keeps} == set(hrefs) - {" //b.nl/y", "http://b.nl", "mailto:x@y", "a.nl:80/x"} and {r.p for r in got if r.keeps} == set(pages[:2])


def test_links_alone_are_those_of_the_whole_page():
    from sitefold.functions.html import hrefs, parse

    for html in (None, b"<a href=caf\xc3\xa9>", "<a href=1 href=2><A HREF='?a=1&copy=2&amp;b'><aside href=3><a>", "<script><a href=1></script><template><a href=2></template><style><a href=3>", "<p title='<a href=1>'><![x[<a href=2>]]><!-- <a href=3> --><a/href=4><a href", "<textarea><a href=1></textarea><p <a href=2>>"):
        assert hrefs(html) == parse(html).hrefs
    assert hrefs("<p a=b><a href=/x>y</a><script>'<a href=z>'</script><a href='/q?a=1&copy=2'>") == ["/x", "/q?a=1&copy=2"]
