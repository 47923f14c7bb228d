"""Near-duplicates (4), toxicity (5), and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sitefold.llm import mixing, packing, token_counts
from sitefold.llm import simhash_forest as S
from sitefold.llm import toxicity as T
from sitefold.llm.tokenizer import VOCABULARY, Encoder


def prose(r, n, vocabulary=4000):
    return " ".join(f"{r.choice('abcdefgh')}w{int(r.paretovariate(0.9)) % vocabulary}" for _ in range(n))


def corpus(seed=1, groups=30, alone=400):
    """Texts, and the group of each."""
    r = random.Random(seed)
    texts, group = [], []
    for g in range(groups):
        base = prose(r, r.randrange(80, 400)).split()
        for _ in range(r.randrange(2, 6)):
            copy = list(base)
            for _ in range(len(copy) * 2 // 100):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(copy))
            group.append(g)
    for k in range(alone):
        texts.append(prose(r, r.randrange(60, 300)))
        group.append(groups + k)
    return texts, group


def brute_groups(texts, distance=S.DISTANCE):
    fp = S.fingerprints(texts)
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in S.close_pairs(fp, distance):
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(texts))]


def test_forest_against_brute_force(spark):
    texts, group = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in S.near_duplicates(df).collect()}
    want = brute_groups(texts)
    same = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    found = sum(got[i].group_id == got[j].group_id for i, j in same)
    assert len(same) > 50 and found >= 0.9 * len(same)
    made = [(i, j) for i in range(len(texts)) for j in range(i) if group[i] == group[j]]
    assert sum(got[i].group_id == got[j].group_id for i, j in made) >= 0.9 * len(made)
    assert all(got[i].group_size == 1 for i in range(len(texts)) if group[i] >= 30)
    assert sum(r.kept for r in got.values()) == len({r.group_id for r in got.values()})


def near_prints(n, far, seed=1, groups=40):
    """Random fingerprints, and for some of them others at just so many bits."""
    r = np.random.default_rng(seed)
    fp = r.integers(0, 2**64, (n, S.WORDS), dtype=np.uint64)
    for g in range(groups):
        flip = np.zeros(S.BITS, bool)
        flip[r.permutation(S.BITS)[:far]] = True
        fp[2 * g + 1] = fp[2 * g] ^ np.packbits(flip, bitorder="little").view(np.uint64)
    return fp


def frame_of(spark, fp):
    return spark.createDataFrame([tuple(int(x) for x in (n, *f.view(np.int64))) for n, f in zip(S.node_ids(fp), fp)], ", ".join(f"{x} long" for x in S._FIELDS))


@pytest.mark.parametrize("most", [S.BRANCH, 20])
@pytest.mark.parametrize("far", [3, 26, 45, 52])
def test_pairs_against_brute_force(spark, far, most):
    """Recall of pairs at several distances; with small branches dense ones are split and their nodes enter more tries."""
    fp = near_prints(1500, far, far, 200)
    nodes, ids = frame_of(spark, fp), S.node_ids(fp)
    want = {tuple(sorted((int(ids[a]), int(ids[b])))) for i, j in S.close_pairs(fp) for a, b in zip(i, j)}
    depths = S.plan_tries(nodes, most=most)
    assert len(depths) >= S.tries_for(S.START) and (most == S.BRANCH) == (max(x.max() for x in depths) == S.START)
    got = {(r.a, r.b) for r in S.verified_edges(nodes, depths, all_pairs=True).collect()}
    assert len(want) >= 200 and got <= want and len(got) >= (0.9 if far < 50 else 0.85) * len(want)


def test_recall_of_whole_forests():
    for distance in (20, 52):
        for tries in (1, 5, 40):
            depth = S.depth_for(tries, distance, 0.95, S.BITS)
            assert 1 - (1 - S.shared_prefix(depth, distance)) ** tries >= 0.95 or depth == 0
            assert 1 - (1 - S.shared_prefix(depth + 1, distance)) ** tries < 0.95
        assert 1 - (1 - S.LOCAL_RECALL * S.shared_prefix(S.START, distance)) ** S.tries_for(S.START, distance) >= S.RECALL
    # below one branch: a forest of its own finds what all pairs find
    fp = near_prints(20_000, 52, 3, 1500)
    assert S.plan_branch(fp)[1] > 0
    want = {(int(min(a, b)), int(max(a, b))) for i, j in S.close_pairs(fp) for a, b in zip(i, j)}
    i, j = S.branch_links(fp, all_pairs=True)
    got = {(int(min(a, b)), int(max(a, b))) for a, b in zip(i, j)}
    assert got <= want and len(got) >= 0.93 * len(want)


def test_branches_split_where_they_are_dense():
    r = np.random.default_rng(5)
    codes = np.sort(np.concatenate([r.integers(0, 1 << 10, 3000), np.full(500, 77)]))
    starts, ends = S.leaves(codes, 10, 40)
    assert starts[0] == 0 and ends[-1] == len(codes) and (starts[1:] == ends[:-1]).all()
    for s, e in zip(starts, ends):
        same = codes[s] ^ codes[e - 1]
        assert e - s <= 40 or same == 0
    counts = np.ones(1 << S.END, np.int64)
    counts[0] = 10_000
    depth = S.branch_depths(counts, 100)
    assert depth[0] == S.END and depth[-1] == S.START and depth[1] == S.END and depth[2] == S.END - 1
    fp = near_prints(100, 52)
    entered = [list(S.entries(fp, [np.full(1 << S.END, k)] * 300)) for k in (S.START, S.END)]
    assert len(entered[0]) == S.tries_for(S.START) < len(entered[1]) == S.tries_for(S.END)


def test_leaves_of_any_size_are_linked():
    """A dense group of near copies, its outskirts, and others: the same components as by all pairs."""
    r = np.random.default_rng(6)
    middle = r.integers(0, 2**64, S.WORDS, dtype=np.uint64)
    flips = np.packbits(r.random((3000, S.BITS)) < np.repeat([0.03, 0.1, 0.16], 1000)[:, None], axis=1, bitorder="little").view(np.uint64)
    fp = np.concatenate([middle ^ flips, r.integers(0, 2**64, (1500, S.WORDS), dtype=np.uint64)])[r.permutation(4500)]
    pairs = [[np.concatenate(x) for x in zip(*f(fp))] for f in (S.close_pairs, S.linked)]
    a, b = (S._labels(i, j, len(fp)) for i, j in pairs)
    assert (a == b).all() and len(pairs[1][0]) < len(pairs[0][0]) / 5
    fp = np.repeat(S.fingerprints(["a b c d"]), 3000, 0)
    assert sum(len(i) for i, _ in S.close_pairs(fp)) == 3000 * 2999 // 2 and sum(len(i) for i, _ in S.linked(fp)) == 2999


def test_chains_are_one_group(spark):
    e = [(i, i + 1) for i in range(300)] + [(1100, 1102), (1101, 1102), (7, 7)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1101] == got[1102] == 1100


EDGE_ROWS = [(1, None), (None, None), (2, ""), (3, ""), (4, "!!"), (5, "!!"), (6, "?"), (7, "one"), (8, "One"), (9, "two words"), (None, "two words"), (9, "two words"), (10, "long " * 100_000), (11, "x")]


def test_forest_edge_cases(spark):
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in EDGE_ROWS], "doc_id long, text string, node string, ROOT int")
    rows = S.near_duplicates(df).collect()
    assert len(rows) == len(EDGE_ROWS)
    kept = sorted((r.doc_id for r in rows if r.kept), key=str)
    assert kept == sorted([1, None, 2, 4, 6, 7, 9, 10, 11], key=str)
    left = S.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted((r.doc_id for r in left.collect()), key=str) == kept
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.drop_near_duplicates(df.limit(0)).count() == 0
    assert S.drop_near_duplicates(df.where("doc_id = 1")).count() == 1


BAD = ["vile", "gross", "rotten", "nasty"]


def labelled_corpus(n=900, seed=3):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(r, r.choice([30, 200, 1500])).split()
        toxic = i % 8 == 0
        for _ in range(r.randrange(1, 6) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic) if r.random() > 0.01 else 1 - int(toxic)))
    # many copies of one toxic document: its harmless words mustn't look toxic
    copied = prose(r, 60) + " vile"
    rows += [(n + k, copied) for k in range(40)]
    labels += [(n + k, 1) for k in range(40)]
    rows += [(n + 100 + k, " ".join(r.sample(copied.split()[:-1], 40))) for k in range(20)]
    return rows, labels


def test_toxic_documents_are_found_held_out(spark):
    rows, labels = labelled_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.flag_toxic(df, lab).collect()}
    known = {i for i, _ in labels}
    bad = {i for i, t in rows if set(t.split()) & set(BAD)}
    out = [i for i, _ in rows if i not in known]
    hit = sum(got[i].is_toxic for i in out if i in bad)
    assert hit >= 0.95 * sum(i in bad for i in out) > 20
    assert sum(got[i].is_toxic for i in out if i not in bad) <= 0.02 * len(out)


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


class Brute:
    """The same models from dictionaries: P_c(w|u) over P_c(w) over the shared share of w."""

    def __init__(self, rows, labels, part=None, without=0):
        y = {}
        for i, c in labels:
            y[i] = max(c, y.get(i, 0))
        held = [(t, y[i]) for i, t in rows if i in y]
        size = [sum(len(words_of(t)) for t, c in held if c == k) for k in (0, 1)]
        self.scale = [n / min(size) for n in size]
        self.pairs, self.follow, self.after = ([Counter(), Counter()] for _ in range(3))
        for t, c in held:
            if without and part[t] == without - 1:
                continue
            w = words_of(t)
            for u, v in zip([None, *w], w):
                self.follow[c][v] += self.pairs[c][u, v] == 0
                self.pairs[c][u, v] += 1
                self.after[c][u] += 1
        self.docs = Counter(w for _, t in rows for w in set(words_of(t)))

    def kept(self, c, d):
        return sum(max(x - d, 0) for x in self.follow[c].values()) / sum(self.follow[c].values())

    def discounts(self, discount):
        """That of the larger class by which it keeps what the smaller one does, by halving."""
        small = int(np.argmin(self.scale))
        high = discount * self.scale[1 - small]
        low = high * T.NEAR
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if self.kept(1 - small, mid) > self.kept(small, discount) else (low, mid)
        return (discount, low) if small == 0 else (low, discount)

    def logs(self, text, discount, ratio):
        """log P_toxic(w|u) - log P_ordinary(w|u) of each word."""
        w, out, total = words_of(text), [], sum(self.docs.values())
        for c, d in enumerate(self.discounts(discount)):
            n = sum(self.follow[c].values())
            left = 1 - sum(max(x - d, 0) for x in self.follow[c].values()) / n
            one = lambda v: max(self.follow[c][v] - d, 0) / n + left * self.docs[v] / total  # noqa: B023, E731
            kept = Counter()
            for (u, v), x in self.pairs[c].items():
                kept[u] += max(x - d * ratio, 0)
            p = []
            for u, v in zip([None, *w], w):
                m = self.after[c][u]
                p.append(one(v) if u is None or not m else max(self.pairs[c][u, v] - d * ratio, 0) / m + (1 - kept[u] / m) * one(v))
            assert not w or abs(sum(map(one, self.docs)) - 1) < 1e-9
            out.append(np.log(p))
        return out[1] - out[0]


def brute_mean(r, window):
    n = min(window or len(r), len(r))
    return max(sum(r[k : k + n]) / n for k in range(len(r) - n + 1)) if len(r) else 0.0


def test_estimates_and_scores_equal_brute_force(spark):
    rows, labels = labelled_corpus(160)
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    part = {r[0]: r[1] for r in df.selectExpr("text", "pmod(xxhash64(text), 5)").collect()}
    g = T.gathered(df.repartition(3), lab)
    assert g.n == len(labels)
    counts = T.counted(g, T.LEAST)
    for discount, ratio, without in ((0.75, 2.0, 0), (0.75, np.inf, 0), (1.5, 2.0, 3), (6.0, 16.0, 1)):
        brute, m = Brute(rows, labels, part, without), T.ratios(counts, discount, ratio, without)
        for window in (8, 0):
            m.window = window
            got = {r.doc_id: r.toxicity for r in T.score(df, m).collect()}
            for i, t in rows[::9]:
                assert got[i] == pytest.approx(brute_mean(brute.logs(t, discount, ratio), window), abs=1e-8)
    model = T.fit(df, lab)
    assert (model.chosen["discount"], model.chosen["pair_ratio"], model.window) in T.settings(counts.least)
    got = {r.doc_id: r for r in T.flag_toxic(df, lab).collect()}
    brute = Brute(rows, labels)
    for i, t in rows[::9]:
        s = brute_mean(brute.logs(t, model.chosen["discount"], model.chosen["pair_ratio"]), model.window)
        assert got[i].toxicity == pytest.approx(s, abs=1e-8) and got[i].is_toxic == (s >= model.threshold)


def test_one_hot_word_in_many_tasks(spark, monkeypatch):
    """Buckets and flushes of any size give the same counts."""
    rows, labels = labelled_corpus(120)
    rows = [(i, " ".join(f"the {w}" for w in t.split())) for i, t in rows]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")
    want = T.counted(T.gathered(df, lab), T.LEAST)
    monkeypatch.setattr(T, "BUCKET", 1000)
    got = T.counted(T.gathered(df.coalesce(1), lab), T.LEAST)
    for a in ("words", "shared", "follow", "sums", "pairs", "pair_counts", "history"):
        assert np.array_equal(getattr(want, a), getattr(got, a))
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert np.array_equal(T.unpack(T.pack(keys), 1000), keys)


def test_toxicity_edge_cases(spark):
    rows, labels = labelled_corpus(300)
    more = [(None, "vile gross"), (5000, None), (5001, ""), (5002, "!?"), (0, rows[0][1]), (5003, "fine " * 200_000 + "vile rotten vile")]
    df = spark.createDataFrame([(i, t, "x", True) for i, t in rows + more], "doc_id long, text string, TOXICITY string, is_toxic boolean")
    lab = spark.createDataFrame([(i, y, 1) for i, y in labels] + [(None, 1, 1), (1, None, 1), (0, 0, 1), (0, 1, 1)], "doc_id long, toxic int, text int")
    model = T.fit(df, lab)
    out = T.score(df, model)
    assert out.columns == ["doc_id", "text", "TOXICITY", "is_toxic", "_toxicity", "_is_toxic"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[None]._is_toxic and got[5003]._is_toxic and not any(got[k]._is_toxic for k in (5000, 5001, 5002)) and got[5000]._toxicity == 0
    left = T.drop_toxic(df, lab)
    assert left.columns == df.columns and 5000 in {r.doc_id for r in left.collect()}
    for few in (lab.limit(0), lab.where("toxic = 0")):
        assert T.flag_toxic(df, few).where("is_toxic").count() == 0
    assert T.flag_toxic(df.limit(0), lab).count() == 0


def test_rare_toxic_words(spark, monkeypatch):
    r = random.Random(4)
    plain = [prose(r, 40) for _ in range(70)]
    # two toxic words in 4 labelled documents each: too few for any test of significance
    toxic = [prose(r, 30) + " vile" for _ in range(4)] + [prose(r, 30) + " gross" for _ in range(4)]
    new = [prose(r, 30) + " vile gross", prose(r, 30)]
    rows = [(i, t) for i, t in enumerate(plain + toxic + new)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i >= len(plain))) for i in range(len(rows) - 2)], "doc_id long, toxic int")
    counts = T.counted(T.gathered(df, lab), T.LEAST)
    one = dict(zip(counts.words.tolist(), T.ratios(counts, T.LEAST, 2.0).word_ratio))
    assert all(one[int(x)] > 1 for x in T.K.word_hash(["vile", "gross"]))
    got = {x.doc_id: x.toxicity for x in T.score(df, T.fit(df, lab)).collect()}
    assert got[len(rows) - 2] > got[len(rows) - 1]
    # where calibration starts with discounts above the counts of both words, it goes down to lower ones
    low = T.fit(df, lab)
    monkeypatch.setattr(T, "FLOOR", 12 / T.gathered(df, lab).small)
    high = T.fit(df, lab)
    assert high.chosen["discount"] < 4 and high.chosen["f1"] >= low.chosen["f1"]
    got = {x.doc_id: x.toxicity for x in T.score(df, high).collect()}
    assert got[len(rows) - 2] > got[len(rows) - 1]
    # only a model too large to be broadcast ends that
    monkeypatch.setattr(T, "MODEL_WORDS", 1)
    assert T.fit(df, lab).chosen["discount"] >= 12


def test_toxic_phrase_of_ordinary_words(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words = prose(r, 40).split()
        toxic = i % 8 == 0
        for x in ["salt", "road"] if not toxic else ["salt road"]:
            words.insert(r.randrange(len(words)), x)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(df, lab)
    at = np.searchsorted(model.words, T.K.word_hash(["salt", "road"])).tolist()
    pair = np.searchsorted(model.pairs, at[0] << 32 | at[1])
    assert np.isfinite(model.chosen["pair_ratio"]) and model.pair_ratio[pair] > 2 and abs(model.word_ratio[at[0]]) < 1
    assert sum(r.is_toxic == (r.doc_id % 8 == 0) for r in T.flag_toxic(df, lab).collect()) >= 0.97 * len(rows)


def test_calibration_counts_pairs_once_where_the_first_round_suffices(spark, monkeypatch):
    """Further rounds try only what is new, and choose what all settings at once would have chosen."""
    rows, labels = labelled_corpus(300)
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    g, tried, counted = T.gathered(df, lab), [], T.counted
    monkeypatch.setattr(T, "counted", lambda g, least: tried.append(least) or counted(g, least))
    # a start that was at 48 when the floor was 5e-6 of the smaller class's words
    monkeypatch.setattr(T, "FLOOR", T.FLOOR * 48 / (5e-6 * g.small))
    model = T.fit(df, lab)
    assert tried[0] == pytest.approx(6) and len(tried) == len(set(tried))
    monkeypatch.setattr(T, "FLOOR", 0)
    monkeypatch.setattr(T, "LEAST", min(tried))
    monkeypatch.setattr(T, "STEPS", 10 + 3 * (len(tried) - 1))
    every = T.fit(df, lab)
    assert every.chosen == model.chosen and every.threshold == model.threshold


def many_labels():
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(22_000):
        toxic = r.random() < 0.1
        text = r.choices(words, k=6) + ([r.choice(BAD)] if toxic or r.random() < 0.03 else [])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic if r.random() < 0.95 else not toxic)))
    return rows + [(30_000, None), (30_001, "")], labels + [(30_000, 1), (30_001, 0)]


def best_of_all_labelled(df, lab, rows, labels, model):
    """The best threshold and its F1 over all rows, each scored by models of the other parts."""
    counts = T.counted(T.gathered(df, lab), T.LEAST)
    y = dict(labels)
    part = {x.doc_id: x.part for x in df.selectExpr("doc_id", "pmod(xxhash64(text), 5) part").collect()}
    score = np.zeros(len(rows))
    for k in range(T.PARTS):
        m = T.ratios(counts, model.chosen["discount"], model.chosen["pair_ratio"], k + 1)
        m.window = model.window
        mine = [j for j, (i, _) in enumerate(rows) if part[i] == k]
        score[mine] = T.text_scores(pa.array([rows[j][1] for j in mine], pa.string()), m)
    return T.best_threshold(score, np.array([y[i] for i, _ in rows]))


@pytest.mark.parametrize("held", [2_000_000, 3000])
def test_calibration_takes_every_labelled_row(spark, monkeypatch, held):
    monkeypatch.setattr(T, "HELD", held, raising=False)  # of any size
    rows, labels = many_labels()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(df, lab)
    cut, f1 = best_of_all_labelled(df, lab, rows, labels, model)
    assert (model.threshold, model.chosen["f1"]) == pytest.approx((cut, f1), abs=1e-9) and 0.5 < f1 < 1


def test_pipeline_calibrates_on_every_labelled_row(spark, monkeypatch, tmp_path):
    rows, labels = many_labels()
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    models, fit = [], T.fit
    monkeypatch.setattr(T, "fit", lambda *x: models.append(fit(*x)) or models[-1])
    left = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, df, str(tmp_path)).collect()}
    cut, f1 = best_of_all_labelled(df, lab, rows, labels, models[0])
    assert (models[0].threshold, models[0].chosen["f1"]) == pytest.approx((cut, f1), abs=1e-9) and 0.5 < f1 < 1
    score = T.text_scores(pa.array([t for _, t in rows], pa.string()), models[0])
    assert left == {i for (i, _), s in zip(rows, score) if s < cut} and 0 < len(left) < len(rows)


def test_threshold_is_best():
    y, s = np.array([1, 1, 0, 1, 0, 0]), np.array([5.0, 4.0, 3.0, 3.0, 0.0, -1.0])
    assert T.best_threshold(s, y) == (1.5, 6 / 7) and T.best_threshold(s[:0], y[:0])[0] == T.best_threshold(s, y * 0)[0] == np.inf


def brute_copies(spark, rows):
    """Passes and rests of each membership pattern, row by row; only the flow is the library's, and tested by itself."""
    enc = Encoder.get(VOCABULARY).enc
    df = spark.createDataFrame([(d[0], d[1]) for d in rows], "doc_id long, text string")
    hashes = {r[0]: r[1] % 2**64 for r in df.selectExpr("doc_id", f"xxhash64({mixing.SEED}, doc_id, text)").collect()}
    patterns = {}
    for i, text, lang, source, _ in rows:
        patterns.setdefault(tuple(sorted({f"source={source or 'unknown'}", f"lang={lang or 'unknown'}"})), []).append((hashes[i], i, len(enc.encode_ordinary(text or ""))))
    sizes = sorted((m, n) for m, x in patterns.items() if (n := sum(t for _, _, t in x)))
    weights = mixing.target_weights(sizes)
    plan = mixing.solve(sizes, weights, max(mixing.least_budget(sizes, weights), int(1.5 * sum(n for _, n in sizes))), mixing.MOST_PASSES)
    copies = {d[0]: 1 for d in rows}
    for (member, n), used in zip(sizes, plan.used):
        total, rest = 0, used % n
        for _, i, t in sorted(patterns[member]):
            if t:
                total += t
                copies[i] = used // n + (rest > 0 and total - t / 2 <= rest)
    return copies


def test_pipeline_against_brute_force(spark, tmp_path):
    texts, group = corpus(5, 12, 150)
    rows, labels = labelled_corpus(240, seed=9)
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, (_, t) in enumerate(rows)]
    docs += [(10_000 + i, t, "fr", "s0", len(t)) for i, t in enumerate(texts)] + [(20_000, None, None, None, None), (20_001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    lab = [(next(k for k, (j, _) in enumerate(rows) if j == i), 1, y) for i, y in labels]
    spark.createDataFrame(lab, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    # the same, document by document
    model = T.fit(table, spark.read.parquet(str(tmp_path / "labels.parquet")))
    brute = Brute([(d[0], d[1]) for d in docs], [(i, y) for i, _, y in lab])
    clean = [d for d in docs if not (words_of(d[1]) and brute_mean(brute.logs(d[1], model.chosen["discount"], model.chosen["pair_ratio"]), model.window) >= model.threshold)]
    named = [d for d in clean if d[1] is not None]
    roots = brute_groups([d[1] for d in named])
    kept = {min(named[k][0] for k in range(len(named)) if roots[k] == r) for r in set(roots)} | {20_000}
    copies = brute_copies(spark, [d for d in clean if d[0] in kept])
    enc = Encoder.get(VOCABULARY).enc
    want = {d[0]: n for d in clean if d[0] in kept and (n := len(enc.encode_ordinary(d[1] or "")) * copies[d[0]])}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want and max(copies.values()) > 1
    assert packing.check_fill(got) > 0.9


@pytest.mark.parametrize("stage", [corpus_pipeline.mixing_stage, corpus_pipeline.packing_stage])
def test_pipeline_counts_pretokens_of_every_row(spark, monkeypatch, tmp_path, stage):
    rows = [(i, "early word" if i < 300 else "later word" if i < 900 else None, "en", "s", 10) for i in range(901)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    tables, count = [], token_counts.frequent_table
    monkeypatch.setattr(token_counts, "frequent_table", lambda *x: tables.append(count(*x)) or tables[-1])
    assert stage(spark, docs, str(tmp_path)).count() >= 900
    enc = Encoder.get(VOCABULARY).enc
    assert tables == [{t: len(enc.encode_ordinary(t)) for t in ("early", "later", " word")}]


def test_stages_keep_the_columns_of_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "mixing_to_target_weights", "best_fit_packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() > 0
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
