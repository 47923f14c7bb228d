import json
import time

import pytest
from pyspark.sql import functions as F

from sitefold import cli
from sitefold.functions import fields as X
from sitefold.functions.html import parse
from sitefold.operators import consolidate as C
from sitefold.operators import extract as E
from sitefold.sources import archive, ndjson, overview_log, settings
from sitefold.streaming import crawl_stream as W

HTML = """<!doctype html><html><head><meta charset="utf-8"><meta name="author" content="A"><meta name="x" property="og:title" content="T"><meta name="unknown" content="u"><title>Ti&amp;tle</title>
<style>p{}</style><script>var a="<p>no</p>";</script></head><body><!-- no --><p>One<b> two</b></p><p>Steiger 10<br>6581 KZ Malden 1234 SS</p><a href="/a">x</a><a>y</a><a href="b" href="c">z</a></body></html>"""


def test_parsing():
    p = parse(HTML)
    assert p.pieces == ["Ti&tle", "One", "two", "Steiger 10", "6581 KZ Malden 1234 SS", "x", "y", "z"]
    assert p.hrefs == ["/a", "b"] and p.meta == {"meta_encoding": "utf-8", "meta_author": "A", "meta_og:title": "T"}
    assert parse(b"caf\xc3\xa9\xff").raw_text == "café" and parse(b"caf\xc3\xa9").text == "café" and parse(None).text == ""


def test_odd_markup_is_read():
    assert parse("a<![foo[x]]>b<![if !IE]>c<![endif]>d<a href=/q>e").pieces == ["a", "b", "c", "d", "e"]
    p = parse("<p>one<template><p>two<a href=/x>three<p>four")
    assert p.pieces == ["one", "two", "three", "four"] and p.hrefs == ["/x"]
    assert parse("one<template>two<template>three</template>four</template>five").pieces == ["one", "five"]
    for text in ("x<![", "x<!-", "<!doctype [<!ELEMENT", "</>", "<a href", "&#xffffffff;", "<\0>"):
        parse(text)


def test_named_references_need_their_semicolon(spark):
    p = parse("<p>R&ampD &amp; &copy2 &notit; &amp;lt; &#65; &#66 &eacute;&am</p>x&amp<br>&&&amp<a href='/q?a=1&copy=2&amp;b=3'>&amp")
    assert p.pieces == ["R&ampD & &copy2 &notit; &lt; A B é&am", "x&amp", "&&&amp", "&amp"] and p.hrefs == ["/q?a=1&copy=2&b=3"]
    assert parse("<script>&amp</script>a<!-- &amp -->b<&amp>").raw_text == "a\nb<&amp>"


@pytest.mark.parametrize("name", ["q_extract_plugin", "q_page_text", "q_page_text_nfkd"])
def test_text_of_cut_references_matches_its_sql(spark, tmp_path, name):
    from sitefold.plans import catalogue

    from .oracle import TABLES, assert_same

    html = '<html><head><meta charset="utf-8"></head><body><ul><li><a href="/and">and&amp</a></li></ul><p>one&&&amp<p>&copy &copy;&middot two&amp;</p>mail a@b.nl&nbsp</body></html>'
    spark.createDataFrame([(1, "https://a.nl/x", html)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    for t in TABLES:
        if t != "pages":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    sql = catalogue.oracle_sql()[name].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert_same(catalogue.queries()[name](spark, str(tmp_path)), sql, "/root/testdata/sf0.001")


def test_one_bad_page_ends_no_job(spark):
    from sitefold.operators import links as L

    rows = spark.createDataFrame([("https://a.nl", "<![foo[x]]><a href=/y>z</a>"), ("https://b.nl", None), (None, "<a href=q>")], "url string, html string")
    assert sorted((r.src_url or "", r.href) for r in L.hrefs(rows).collect()) == [("", "q"), ("https://a.nl", "/y")]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_zip_codes_and_addresses(spark):
    t = "Jan\nSteiger 10\n6581 KZ Malden\nNL-1234AB x\ngevestigd aan Korte Weg 5, 1111 SA\n2222BB"
    z = one(spark, t, X.zipcodes("t"))
    assert z == ["6581 KZ", "NL-1234AB", "2222BB"]
    assert one(spark, "x gevestigd aan de Dam 1, 1012 JS", X.addresses("t", X.zipcodes("t"))) == ["x   de Dam 1"]
    assert one(spark, "Steiger 10\n6581 KZ", X.addresses("t", X.zipcodes("t"))) == ["Steiger 10"]
    assert one(spark, "Steiger 10\nNL- 6581 KZ", X.addresses("t", X.zipcodes("t"))) == ["Steiger 10"]
    assert one(spark, "te 6581 KZ", X.addresses("t", X.zipcodes("t"))) == []
    assert one(spark, None, X.zipcodes("t")) is None and one(spark, "12345 AB", X.zipcodes("t")) == []


def test_contact_fields(spark):
    assert one(spark, "Tel: 020-1234567 t. 0612345678x Telefoon: (010) 123 45 67.", X.phones("t")) == ["020-1234567 ", "(010) 123 45 67"]
    assert one(spark, "a.b@c.nl logo@2x.png x@y.PDF a.b@c.nl", X.emails("t")) == ["a.b@c.nl"]
    assert one(spark, "Fax: +31 20 1234567 faxnumber 020-7654321", X.faxes("t")) == ["+31 20 1234567", "020-7654321"]
    assert one(spark, "KvK 12345678, K.v.K. nr 87654321; Kamer van Koophandel onder 11112222. kvk 123456789", X.kvk_numbers("t")) == ["12345678", "87654321", "11112222"]
    assert one(spark, "BTW nr: NL123456789B01", X.vat_numbers("t")) == ["NL123456789B01"]
    links = spark.createDataFrame([(["/annual-report.pdf", "http://x.nl/jaarverslag", "/annual-report?privacy", "/annual-report-webshopp", "x"], "https://a.nl/b/c")], "h array<string>, u string")
    assert links.select(X.report_links("h", "u")).first()[0] == ["https://a.nl/annual-report.pdf", "http://x.nl/jaarverslag"]


def pages(spark, bodies):
    return spark.createDataFrame([("a.nl", str(i), 0, f"https://a.nl/{i}", "2024-01-01", f"p{i}", b) for i, b in enumerate(bodies)], "domain string, identifier string, level int, url string, session_date string, path string, html string")


def test_records_plugins_errors_and_timeouts(spark):
    def slow(page):
        if page.html == "slow":
            time.sleep(5)
        if page.html == "bad":
            raise ValueError
        return [page.html[:3]]

    extra = E.contact_fields()
    extra.register_field("probe", slow)
    rows = E.extract(pages(spark, [HTML, "slow", "bad", None, ""]), extra, timeout=0.5).orderBy("identifier").collect()
    assert [r.path for r in rows] == ["p0", E.TIMED_OUT, E.FAILED, E.FAILED, "p4"]
    assert rows[0].zipcode == ["6581 KZ"] and rows[0].address == ["Steiger 10"] and rows[0].probe == ["<!d"] and rows[0].meta["meta_author"] == "A" and rows[4].text == "" and rows[1].text is None
    plain = E.extract(pages(spark, [HTML]))
    assert not {"phone", "email", "fax"} & set(plain.columns)
    own = E.Fields(page={"zipcode": lambda p: ["0000 XX"]})
    assert E.extract(pages(spark, [HTML]), own).first().zipcode == ["0000 XX"]
    assert E.is_error(E.extract(pages(spark, [None, HTML]))).count() == 1


RECORDS = "domain string, identifier string, phone array<string>, email array<string>, fax array<string>, zipcode array<string>, address array<string>, kvk array<string>, btw array<string>, text string, ord long"


def records(spark, rows):
    return spark.createDataFrame([(d, i, p, None, [], None, None, k, None, t, n) for n, (d, i, p, k, t) in enumerate(rows, 1)], RECORDS)


ROWS = [("https://www.a.co.uk/x", "1", ["06", "06"], ["12345678"], "one"), ("b.nl", "2", None, None, None), ("a.co.uk", "3", ["06", "07"], ["12345678"], "two"), ("a.co.uk", "4", None, None, "three"), (None, "5", ["08"], None, "lost")]


@pytest.mark.parametrize("chunk, text", [(None, " one two three"), (2, " one  two three"), (100, " one two three"), (1, " one  two  three")])
def test_consolidation(spark, chunk, text):
    got = {r.domain: r for r in C.consolidated(records(spark, ROWS), chunk_size=chunk).collect()}
    assert set(got) == {"a.co.uk", "b.nl"}
    a = got["a.co.uk"]
    assert a.identifier == "1" and a.phone == {"06": 3, "07": 1} and a.kvk == {"12345678": 2} and a.address == {} and a.text == text
    assert got["b.nl"].text == " " and got["b.nl"].identifier == "2"


def test_chunks_whatever_partitions_are_joined(spark):
    """Adaptive execution joins the small partitions of a plan without texts otherwise than those of one with them."""
    n = 5000
    rows = spark.range(n).select(
        F.concat(F.lit("a"), (F.col("id") % 3).cast("string"), F.lit(".nl")).alias("domain"), F.col("id").cast("string").alias("identifier"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int") * 20).alias("text"), (F.col("id") * 7 % n).alias("ord")
    )
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        numbered = C._numbered(rows)
        assert sorted(r[0] for r in numbered.select("_no").collect()) == list(range(1, n + 1))
        assert numbered.where(F.col("_no") != F.col("ord") + 1).count() == 0
        got = {r.domain: r for r in C.consolidated(rows, fields=(), chunk_size=100).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {}
    for i in sorted(range(n), key=lambda i: i * 7 % n):
        want.setdefault(f"a{i % 3}.nl", {}).setdefault(i * 7 % n // 100, []).append("x" * (i % 50 * 20))
    assert {d: r.text for d, r in got.items()} == {d: " ".join(" " + " ".join(t) for t in chunks.values()) for d, chunks in want.items()}


def test_consolidated_tables_merge(spark):
    a, b = C.consolidated(records(spark, ROWS[:2])), C.consolidated(records(spark, ROWS[2:]))
    got = {r.domain: r for r in C.merged(a, b).collect()}["a.co.uk"]
    assert got.phone == {"06": 3, "07": 1} and got.text == " one  two three" and got.identifier == "1"
    assert C.consolidated(records(spark, ROWS).limit(0)).count() == 0


def test_ndjson_round_trip(spark, tmp_path):
    out = str(tmp_path / "extracted_data")
    r = E.extract(pages(spark, [HTML, None]))
    ndjson.write_records(r, out, "2024-01-01")
    ndjson.write_records(r, out, "2024-01-01")
    lines = [json.loads(x) for p in (tmp_path / "extracted_data" / "run_date=2024-01-01").glob("part*") for x in p.read_text().splitlines()]
    assert len(lines) == 2 and {x.get("meta_author") for x in lines} == {"A", None}
    bad = tmp_path / "x.ndjson"
    bad.write_text('{"domain":"a.nl","phone":["1"],"other":2}\nnull\nnot json\n[1]\n{"domain":"b.nl"}\n')
    back = ndjson.read_records(spark, str(bad)).orderBy("ord").collect()
    assert [(x.domain, x.phone) for x in back] == [("a.nl", ["1"]), ("b.nl", None)]
    final = str(tmp_path / "out")
    ndjson.write_consolidated(C.consolidated(records(spark, ROWS)), final)
    assert [json.loads(x)["domain"] for x in (tmp_path / "out").read_text().splitlines()] == ["a.co.uk", "b.nl"]
    ndjson.write_consolidated(C.consolidated(records(spark, ROWS).limit(0)), final)
    assert (tmp_path / "out").read_text() == "" and not [p for p in tmp_path.iterdir() if p.name.startswith("_out")]
    (tmp_path / "newer.ndjson").write_text("")
    import os

    os.utime(tmp_path / "x.ndjson", (1, 1))
    (tmp_path / "z.txt").write_text("")
    assert ndjson.latest_file(spark, str(tmp_path)).endswith("newer.ndjson")
    with pytest.raises(FileNotFoundError):
        ndjson.latest_file(spark, str(tmp_path / "extracted_data"))
    assert ndjson.output_path(source="/t/extracted_data/x.ndjson") == "/t/consolidated_data/consolidated.ndjson" and ndjson.output_path("o", "d") == "o"
    with pytest.raises(ValueError):
        ndjson.output_path(source="/t/x")


def test_archives(spark, tmp_path):
    path = f"file://{tmp_path}/crawled_data"
    rows = spark.createDataFrame([("a.nl", "2024-01-01/index", bytearray(b"caf\xc3\xa9\xff")), ("a.nl", "2024-01-01/x", bytearray(b"")), ("b.nl", "y", bytearray(b"z"))], "zip_name string, member string, content binary")
    assert archive.write_archives(rows, path) == 2
    back = archive.read_archives(spark, path)
    assert back.count() == 3
    log = spark.createDataFrame([("/t/crawled_data/a.nl/2024-01-01/index",), ("crawled_data/c.nl/index",)], "path string")
    assert sorted((r.html or "-") for r in archive.with_pages(log, back).collect()) == ["-", "café"]


def test_streams(spark, tmp_path):
    log = "a.nl|i|0|u1|200|2024-01-01|2024-01-01 10:00:00|p\na.nl|i|0|u1|200|2024-01-01|2024-01-01 10:05:00|p\na.nl|i|0|u2|429|2024-01-01|2024-01-01 11:00:00|p"
    rows = spark.createDataFrame([(*(x := r.split("|"))[:2], int(x[2]), *x[3:]) for r in log.splitlines()], W.SCHEMA)
    src = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(src)

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert len(run(W.deduplicated(W.log_stream(spark, src)).select("url", "status"), "append", "dedupe")) == 2
    counts = run(W.status_counts(W.log_stream(spark, src)).selectExpr("status", "pages"), "complete", "counts")
    assert sorted(map(tuple, counts)) == [("200", 2), ("429", 1)]
    waits = run(W.waits(W.log_stream(spark, src).selectExpr("domain", "crawl_ts", "url as ord", "status", "cast(null as double) retry_after")), "update", "waits")
    assert [(r.domain, r.wait) for r in waits] == [("a.nl", 6.0)]
    out = str(tmp_path / "out")
    for k in range(2):
        q = W.append_once(W.log_stream(spark, src), out, str(tmp_path / f"c{k}")).start()
        q.processAllAvailable()
        q.stop()
    assert overview_log.read_log(spark, out).count() == 2


def test_settings_and_plugins(tmp_path):
    s = settings.Settings(str(tmp_path))
    assert not s.initialised() and s.use_database
    s.target_folder, s.delete_after, s.use_database = str(tmp_path / "t"), "yes", "0"
    again = settings.Settings(str(tmp_path))
    assert again.initialised() and again.delete_after and not again.use_database and not again.restore(str(tmp_path / "no")) and again.restore(str(tmp_path))
    one_class = "from sitefold.sources.settings import FieldPlugin\nclass P(FieldPlugin):\n    def extract_vat(self, page):\n        return ['x']\n"
    cases = {"one": one_class, "two": one_class + "class Q(FieldPlugin): pass\n", "none": "x = 1\n", "broken": "x =\n"}
    for name, text in cases.items():
        (tmp_path / f"{name}.py").write_text(text)
    got = {n: settings.load_plugin(str(tmp_path / f"{n}.py"))[0] for n in cases}
    assert set(got["one"].page) == {"vat"} and got["two"] is got["none"] is got["broken"] is None and settings.load_plugin("nowhere.py")[0] is None and settings.load_plugin(None)[0] is None
    assert not settings.has_crawled_data(str(tmp_path))
    (tmp_path / "crawled_data" / "x").mkdir(parents=True)
    assert settings.has_crawled_data(str(tmp_path))
    assert [settings.parse_bool(x) for x in ("1", "TRUE", "on", "no", "")] == [True, True, True, False, False]


def test_backends(tmp_path):
    r = overview_log.resolve_backend
    assert r(str(tmp_path), "TSV") == "csv" and r(str(tmp_path), use_database=False) == "csv" and r(str(tmp_path)) == "duckdb"
    (tmp_path / "overview_urls.db").touch()
    assert r(str(tmp_path), use_database=False) == "sqlite"
    (tmp_path / "overview_urls.duckdb").touch()
    assert r(str(tmp_path)) == "duckdb"
    with pytest.raises(ValueError):
        r(str(tmp_path), "oracle")


def test_command_line(spark, tmp_path, capsys):
    f, t = str(tmp_path / "i"), str(tmp_path / "t")
    store = str(tmp_path / "pages")
    spark.createDataFrame([("https://a.nl", HTML)], "url string, html string").write.parquet(store)
    seeds = tmp_path / "s.csv"
    seeds.write_text("url,id\nhttps://a.nl,7\n")
    run = lambda *a: cli.main(["--folder", f, *a])
    with pytest.raises(SystemExit):
        run("extract")
    run("init", t, "--source", str(seeds))
    with pytest.raises(SystemExit):
        run("extract")
    run("crawl", "--pages", store, "--date", "2024-01-05", "--max-level", "1")
    with pytest.raises(SystemExit):
        run("extract", "--start-date", "2024-01-02")
    run("extract", "--contacts", "--start-date", "2024-01-01", "--end-date", "2024-01-31")
    run("consolidate", "--output", str(tmp_path / "o"))
    run("config")
    out = [json.loads(x) for x in (tmp_path / "o").read_text().splitlines()]
    assert out[0]["domain"] == "a.nl" and out[0]["identifier"] == "7" and out[0]["zipcode"] == {"6581 KZ": 1}
    assert run("restore", str(tmp_path / "nowhere")) == 1
    # without a database the log is a tab-separated one; records are written at once, and only the latest run is consolidated
    f = str(tmp_path / "j")
    run("init", str(tmp_path / "u"), "--source", str(seeds), "--no-database")
    with pytest.raises(SystemExit):
        run("crawl", "--pages", store, "--complement", "2024-01-05")
    for day in ("2024-01-05", "2024-03-05"):
        run("crawl", "--pages", store, "--date", day, "--max-level", "1", "--extract", "--contacts")
    assert (tmp_path / "u" / "overview_tsv").is_dir() and not (tmp_path / "u" / "crawled_data").exists()
    run("consolidate")
    out = [json.loads(x) for x in (tmp_path / "u" / "consolidated_data" / "consolidated.ndjson").read_text().splitlines()]
    assert out[0]["zipcode"] == {"6581 KZ": 1}
    assert run("crawl", "--pages", store, "--date", "2024-03-06", "--complement", "2024-03-05") == 0
    run("config")
    assert "storage csv" in capsys.readouterr().out


def test_package_exports():
    import sitefold

    assert sitefold.extract is E.extract and "crawl" in sitefold.__all__
    with pytest.raises(AttributeError):
        sitefold.nothing


def test_log_table(spark, tmp_path):
    overview_log.create_log(spark, "own_log", f"file://{tmp_path}/own_log")
    spark.sql("INSERT INTO own_log (domain, url, status, session_date) VALUES ('a.nl', 'u', '200', '2024-01-01'), ('a.nl', 'v', '500', '2024-01-01')")
    rows, seen = overview_log.observed(spark.table("own_log"))
    assert rows.count() == 2 and seen.get == {"pages": 2, "errors": 1}
    spark.sql("DROP TABLE own_log")
