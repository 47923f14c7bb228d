"""Top-k search (2), WARC (6), media (7), URL filters (1), mixing (10)."""

import io
import itertools
import math
import re
import wave
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold.llm import media as M
from sitefold.llm import mixing as X
from sitefold.llm import topk_search as S
from sitefold.llm import url_filters as U
from sitefold.llm import warc_index as W
from sitefold.llm.queries import oracle_sql, queries

from ..oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert_same(queries()[name](spark, SF), oracle_sql()[name], SF)


def brute_search(docs, queries_, top):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bags = [Counter(words(t)) for _, t in docs]
    n, mean = len(docs), sum(sum(b.values()) for b in bags) / max(1, len(docs)) or 1.0
    df = Counter(w for b in bags for w in b)
    out = []
    for item, q in queries_:
        scored = []
        for (d, _), b in zip(docs, bags):
            s = sum(c * int(S.impacts(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)), np.float64(b[w]), np.float64(sum(b.values())), mean)) for w, c in Counter(words(q)).items() if w in b)
            if s:
                scored.append((-s, d is None, d or 0))
        out += [(item, k, None if x[1] else x[2], -x[0]) for k, x in enumerate(sorted(scored)[:top], 1)]
    return out


def test_search_equals_brute_force(spark):
    r = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{int(x)}" for x in r.zipf(1.5, n) % 40)
    docs = [(i, text(30)) for i in range(60)] + [(3, "w1 w2"), (None, "w1 w2"), (None, None), (61, ""), (62, "W1, é w5 " * 3000)]
    asked = [(i, text(6)) for i in range(8)] + [(8, None), (9, ""), (10, "nothing"), (2, "w1 w1 w2")]
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, score int, Q int").repartition(3)
    q = spark.createDataFrame([(a, b, 1) for a, b in asked], "item_id long, text string, doc_id int")
    want = sorted(brute_search(docs, asked, 5), key=str)
    for chunk in (4096, 3):
        got = sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in S.top_k(d, q, 5, chunk).collect()), key=str)
        assert got == want
    assert S.top_k(d.limit(0), q).count() == 0 and S.top_k(d, q.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, key string, FILE int"


def test_archive_and_look_up(spark):
    rows = [(i, f"http://www.h{i % 7}.example.com/{i % 50}?q={i % 3}#f", f"<p>é{i}</p>" * (i % 4)) for i in range(1600)]
    rows += [(2000, None, "x"), (2001, "HTTPS://A.b", None), (2002, "https://a.B/", ""), (2003, "no host", "y"), (None, "https://a.b/", "z"), (2003, "no host", "y"), (2004, "https://long.example/", "漢" * 300_000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], PAGES).repartition(3)

    def key(u):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)([^#]*)", u)
        return ")" + u if not m else ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] if m[2].startswith("/") else "/" + m[2])

    import hashlib

    by = {}
    for p, u, h in rows:
        if u is not None and h is not None:
            by.setdefault(key(u), []).append((p, h.encode()))
    want = [(p, u, key(u), c, len(h), hashlib.md5(h).hexdigest()) for p, u, _ in rows if u is not None for c, h in by.get(key(u), [])]
    got = [tuple(r) for r in W.archive_and_look_up(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert W.archive_and_look_up(df.limit(0)).count() == 0


def test_records_are_gzip_members_of_their_own():
    import gzip

    a, b = W.record("http://a.nl/\n", "one", "1"), W.record("http://b.nl/", "", "2")
    assert W.payload(a) == b"one" and W.payload(b) == b"" and gzip.decompress(a + b).count(b"WARC/1.1") == 2 and b"a.nl/%0A\r\n" in gzip.decompress(a)


def brute_fingerprint(x):
    n = (len(x) - M.FRAME) // M.HOP + 1
    window = np.hanning(M.FRAME)
    s = [[round(abs(v), 6) for v in np.fft.rfft(x[k * M.HOP : k * M.HOP + M.FRAME] * window)] for k in range(max(n, 0))]
    found = []
    for t, row in enumerate(s):
        for f, v in enumerate(row):
            near = [s[a][b] for a in range(max(0, t - M.NEAR), min(n, t + M.NEAR + 1)) for b in range(max(0, f - M.NEAR), min(len(row), f + M.NEAR + 1))]
            if v == max(near) and v > np.mean(row) and v > 1e-4:
                found.append((t, f))
    out = []
    for i, (t, f) in enumerate(found):
        out += [(t, (f << 16) | (g << 6) | (u - t)) for u, g in found[i + 1 : i + 1 + M.FAN] if u - t <= M.SPAN]
    return sorted(out)


def test_fingerprints_equal_brute_force(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, n)]) for i, n in enumerate((64, 5, 20, 1))] + [(4, None), (5, []), (6, [float("nan"), None, 0.2] * 5), (0, [0.1] * 9), (8, [0.2, -0.4, 0.1, 0.7] * 100)]
    df = spark.createDataFrame([(*x, "s", 3) for x in rows], "vec_id long, embedding array<double>, SECONDS string, wav int")
    got = {(r.vec_id, r.seconds): r for r in M.fingerprint_embeddings(df).collect()}
    assert len(got) == len(rows)
    for i, v in rows:
        w = M.tone(v)
        if w is None:
            assert got[i, None].fingerprint is None
            continue
        x, rate = M.samples(w)
        assert rate == M.RATE and [(p.t, p.code) for p in got[i, len(x) / rate].fingerprint] == brute_fingerprint(x)
    named = M.with_fingerprints(M.with_tones(df))
    assert named.columns == ["vec_id", "embedding", "SECONDS", "wav", "_wav", "_seconds", "rate", "fingerprint"]
    assert M.fingerprint_embeddings(df.limit(0)).count() == 0


@pytest.mark.parametrize("width, channels", list(itertools.product((1, 2, 3, 4), (1, 2))))
def test_wav_widths(width, channels):
    value = {1: b"\xc0", 2: b"\x00\x40", 3: b"\x00\x00\x40", 4: b"\x00\x00\x00\x40"}[width]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(8000)
        w.writeframes(value * channels * 10)
    x, _ = M.samples(out.getvalue())
    assert len(x) == 10 and x == pytest.approx(0.5)


def wav_head(width, rate, channels=1, data=bytes(800)):
    import struct

    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * width, channels * width, 8 * width) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def test_odd_headers_have_no_fingerprint():
    assert M.fingerprint(wav_head(2, 8000)) is not None
    for width, rate, channels in ((2, 0, 1), (8, 8000, 1), (5, 8000, 1), (0, 8000, 1), (2, 8000, 0)):
        assert M.fingerprint(wav_head(width, rate, channels)) is None
    assert len(M.fingerprint(wav_head(2, 8000, 1, b"\0"))[2]) == 0


def test_bytes_that_arent_wav():
    assert M.fingerprint(b"") is None and M.fingerprint(b"RIFFxxxx") is None and M.fingerprint(None) is None
    assert len(M.fingerprint(M.tone([float("nan")] * 30))[2]) == 0


def test_url_templates(spark):
    pages, labels, n = [], [], 0
    for host, bad in (("good.example", 0), ("bad.example", 1)):
        for part in ("news", "blog"):
            for i in range(60):
                pages.append((n, f"https://{host}/{part}/slug-{chr(97 + i % 26)}{'x' * (i // 26)}/{n}.html?u#f"))
                labels.append((n, 1 - bad, 0))
                n += 1
    for i in range(40):  # one branch of a good host is bad
        pages.append((n, f"http://good.example/spam/{n}/"))
        labels.append((n, None, 1))
        n += 1
    pages += [(9001, None), (9002, "no host"), (9003, "https://new.example/2024-01-31/deadbeef01/" + "/".join("abcdefghijklmnop")), (9004, "https://new.example/"), (9003, "https://new.example")]
    df = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, template string, LABELLED int")
    lab = spark.createDataFrame([(*x, 0) for x in labels] + [(None, 0, 1, 0), (0, None, None, 0), (0, 1, 0, 0)], "doc_id long, quality int, toxic int, url int")
    got = U.filter_urls(df, lab).toPandas()
    assert len(got) == len(pages)
    by = got.drop_duplicates(["host", "template"]).set_index(["host", "template"])
    assert by.loc[("good.example", "/(blog|news)/{*}/{num}.html"), "labelled"] == 120
    assert by.loc[("bad.example", "/(blog|news)/{*}/{num}.html"), "rejected"] and by.loc[("good.example", "/spam/{num}"), "rejected"]
    assert got.rejected.sum() == 160
    all_bad = (120 + 40) / 280
    host_bad = (40 + U.STRENGTH * all_bad) / (160 + U.STRENGTH)
    assert by.loc[("good.example", "/spam/{num}"), "purity"] == pytest.approx(1 - (40 + U.STRENGTH * host_bad) / (40 + U.STRENGTH), abs=1e-6)
    new = got[got.page_id == 9003].template.tolist()
    assert "/{date}/{hex}/" + "/".join("abcdefghijklmnop") in new and "/" in new
    assert got[got.page_id == 9001].template.isna().all() and got[got.page_id == 9002].host.item() == ""
    none = U.filter_urls(df, lab.limit(0))
    assert none.where("rejected or purity <> 1").count() == 0 and U.filter_urls(df.limit(0), lab).count() == 0


def brute_merged(siblings):
    """The same merging of siblings, all neighbours looked at again after every step."""
    def by_neighbours(members):
        while True:
            gaps = [(U.gap(a[1], b[1]), k) for k, (a, b) in enumerate(zip(members, members[1:]))]
            best = min(gaps, default=(math.inf, 0))
            if best[0] == math.inf:
                return members
            k = best[1]
            members[k : k + 2] = [(members[k][0] + members[k + 1][0], U.joined(members[k][1], members[k + 1][1]))]

    alike = {}
    for m in siblings:
        alike.setdefault(tuple(sorted(m[1].spread())), []).append(m)
    left = [m for same in alike.values() for m in by_neighbours(sorted(same, key=lambda m: (m[1].share(), m[0])))]
    most = lambda m: max(m[1].spread().items(), key=lambda x: (x[1], x[0]), default=("", 0))[0]
    return {tuple(sorted(names)) for names, _ in by_neighbours(sorted(left, key=lambda m: (most(m), m[1].share(), sorted(m[0])[0])))}


def url_tree(rows):
    root = U._Node()
    for i, (segs, n, labelled, bad) in enumerate(rows):
        node = root
        for x in [None, *segs]:
            node = node if x is None else node.children.setdefault(x, U._Node())
            node.n, node.labelled, node.bad = node.n + n, node.labelled + labelled, node.bad + bad
        node.leaves.append(i)
        node.ends += n
    return root


def test_merging_equals_brute_force():
    r = np.random.default_rng(11)
    for size in (2, 5, 19):
        for _ in range(30):
            rows = []
            for k in range(size):
                rate, style = r.choice([0.02, 0.5, 0.97]), r.integers(0, 3)
                for leaf in ({"{num}", "a"}, {"{num}"}, {"b", "c", "{num}"})[style]:
                    n = int(r.integers(1, 60))
                    rows.append(([f"s{k}", leaf], n, n, int(r.binomial(n, rate))))
            tree = url_tree(rows)
            want = brute_merged([([k], c) for k, c in sorted(tree.children.items())])
            got = {}
            for (segs, *_), (t, _, _) in zip(rows, U.host_templates(rows)):
                got.setdefault(t.split("/")[1], set()).add(segs[0])
            have = [x for x in got.values()]
            names = {tuple(sorted(x)) for x in have}
            assert names == want


def test_unequal_but_similar_branches_are_merged():
    rows = [([b, leaf], n, n, 0) for b, more in (("a", ()), ("b", (("odd", 1),))) for leaf, n in (("{num}", 50), ("list", 50), *more)]
    rows += [(["c", "about"], 80, 80, 0), (["d", "{num}"], 50, 50, 49), (["d", "list"], 50, 50, 49)]
    got = {t for t, _, _ in U.host_templates(rows)}
    assert "/(a|b)/{num}" in got and "/(a|b)/(list|odd)" in got and "/c/about" in got and "/d/list" in got


def test_many_siblings_are_merged_fast():
    import time

    rows = [([f"s{k:06}", "{num}"], 30, 10, (k % 2) * 10) for k in range(30_000)]
    began = time.time()
    siblings = [([s[0]], c) for s, c in ((r[0], url_tree([r]).children[r[0][0]]) for r in rows)]
    left = U._merge_neighbours(sorted(siblings, key=lambda m: (m[1].share(), m[0])))
    assert len(left) == 2 and time.time() - began < 20
    assert len({t for t, _, _ in U.host_templates(rows)}) == 1  # so many literals vary


def test_levels_in_spark_and_by_host_agree(spark):
    r = np.random.default_rng(12)
    rows = []
    for i in range(800):
        deep = "/".join(f"x{int(r.integers(0, 3))}" for _ in range(int(r.integers(0, 5))))
        rows.append((i, f"https://h{int(r.integers(0, 3))}.example/{'abc'[i % 3]}/slug-{'xyzuvw'[i % 6]}{'q' * int(r.integers(0, 40))}/{deep}" + ("/{odd}" if i % 50 == 0 else "")))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    own = U.generalised
    results = []
    for few in (10**9, 0, 200):
        try:
            U.generalised = lambda t, few=few: own(t, few)
            results.append(sorted(map(str, U.filter_urls(pages, labels).collect())))
        finally:
            U.generalised = own
    assert results[0] == results[1] == results[2] and any("%7Bodd}" in x for x in results[0])
    long = spark.createDataFrame([(1, "https://a.example/" + "/".join("ab" * 3000)), (2, "https://b.example/" + "z" * 200_000)], "page_id long, url string")
    assert {len(r.template) for r in U.filter_urls(long, labels).collect()} == {12_000, 200_001}


def test_weights_without_cover_end(spark):
    df, rows = mixed_docs(spark)
    out, plan = X.mix(df, weights={"source=s0": 1})
    assert plan.budget and {r.source for r in out.where(F.col(out.columns[-1]) > 0).where("text <> ''").collect()} == {"s0"}
    out, plan = X.mix(df, weights={"source=nowhere": 1, "source=big": 0, "source=s1": -1})
    assert not plan.used or sum(plan.used) == 0
    assert out.where(F.col(out.columns[-1]) > 0).where("text <> ''").count() == 0


def test_flow_is_cheapest():
    pats = [(("a", "b"), 3), (("b",), 2), (("a",), 1)]
    w = {"a": Fraction(1, 2), "b": Fraction(1, 2)}
    for budget in (4, 8, 12):
        plan = X.solve(pats, w, budget, 3)
        best = None
        for use in itertools.product(*(range(3 * n + 1) for _, n in pats)):
            for to_a in range(use[0] + 1):
                a, b = to_a + use[2], use[0] - to_a + use[1]
                if a <= budget // 2 and b <= budget // 2:
                    cost = sum(sum(min(n, u - r * n) * r for r in range(3) if u > r * n) for u, (_, n) in zip(use, pats))
                    best = min(best or (0, 0), (-(a + b), cost)) if best else (-(a + b), cost)
        got_cost = sum(sum(min(n, u - r * n) * r for r in range(3) if u > r * n) for u, (_, n) in zip(plan.used, pats))
        assert (-sum(plan.used), got_cost) == best


def mixed_docs(spark):
    r = np.random.default_rng(3)
    rows = [(i, "word " * int(r.integers(1, 40)), "big" if i % 4 else f"s{i % 3}", "en" if i % 5 else "fr", "o", 7) for i in range(800)]
    rows += [(900, None, "big", "en", "o", 7), (901, "", None, None, "o", 7), (None, "a b c", None, "en", "o", 7), (5, rows[5][1], *rows[5][2:])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_copies string, _WHOLE int"), rows


def test_mixing_keeps_all_and_meets_quotas(spark):
    df, rows = mixed_docs(spark)
    out, plan = X.mix(df, alpha=0.5, sources=("source",))
    got = out.toPandas()
    name = out.columns[-1]
    assert name == "_n_copies" and len(got) == len(rows) and (got[name] >= 1).all() and got[name].max() <= X.MOST_PASSES
    enc = X.VOCABULARY
    from sitefold.llm.tokenizer import Encoder

    size = dict(zip(range(len(rows)), Encoder.get(enc).counts([r[1] for r in rows])))
    got["tokens"] = Encoder.get(enc).counts(got.text.tolist())
    sums = (got.tokens * got[name]).groupby("source=" + got.source.fillna("unknown")).sum()
    for s, q in plan.quotas.items():
        assert abs(sums[s] - min(q, sums[s])) <= 40 or sums[s] <= q + 40
    assert sum(plan.used) == pytest.approx((got.tokens * got[name]).sum(), rel=0.02) and sum(size.values()) < sum(plan.used)
    assert X.repeated(out, name).count() == got[name].sum() and X.repeated(out, name).columns == df.columns


def test_mixing_to_a_small_budget(spark):
    df, rows = mixed_docs(spark)
    out, plan = X.mix(df, weights={"source=big": 1, "source=s0": 1}, budget=2000)
    got = out.toPandas()
    got["k"] = got[out.columns[-1]]
    from sitefold.llm.tokenizer import Encoder

    tokens = (Encoder.get(X.VOCABULARY).counts(got.text.tolist()) * got.k).sum()
    assert abs(tokens - 2000) <= 80 and got[got.source.isin(["s1", "s2"])].k.sum() == 0
    again, _ = X.mix(df.repartition(5), weights={"source=big": 1, "source=s0": 1}, budget=2000)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    # brute force: documents of a pattern in hash order, up to the nearest to the rest
    h = df.select("doc_id", "source", "lang", "text", F.xxhash64(F.lit(X.SEED), "doc_id", "text").alias("h")).toPandas()
    h["n"] = Encoder.get(X.VOCABULARY).counts(h.text.tolist())
    for (src, lang), part in h[h.source.isin(["big", "s0"])].groupby(["source", "lang"]):
        part = part[part.n > 0].assign(u=lambda x: x.h.to_numpy().view("uint64")).sort_values("u")
        chosen = got[(got.source == src) & (got.lang == lang) & (got.k > 0) & (got.text.fillna("") != "")]
        first = part.groupby("u", sort=True).doc_id.apply(list).tolist()
        ids = [i for x in first for i in x][: len(chosen)]
        assert sorted(ids) == sorted(chosen.doc_id.tolist())


def test_mixing_empty_tables(spark):
    df, _ = mixed_docs(spark)
    assert X.mix(df.limit(0))[0].count() == 0 and X.mix(df.where("text is null"))[0].first()["_n_copies"] == 1
    assert math.isclose(float(sum(X.target_weights([(("a", "b"), 5), (("a",), 9)]).values())), 1)
