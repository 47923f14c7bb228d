"""Array kernel, tokenizer, token counts (8), token store (3), packing (9)."""

import random
from collections import Counter

import numpy as np
import pytest

from sitefold.llm import kernel as K
from sitefold.llm import packing as P
from sitefold.llm import token_counts as C
from sitefold.llm import token_store as S
from sitefold.llm.shared import new_path
from sitefold.llm.tokenizer import VOCABULARY, Encoder

TEXTS = [None, "", "  ", "It's a cat's life, isn't it?\n\n  'tis 123 a1b2 $$ x'y'll'LL", "dé漢字 🙂 naïve x", "word " * 3000, "a" * 5000, "It's a cat's life, isn't it?\n\n  'tis 123 a1b2 $$ x'y'll'LL"]


def documents(spark, texts=TEXTS, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, N long")


def test_tokens_equal_the_library_on_random_texts():
    enc, r = Encoder.get(VOCABULARY), random.Random(3)
    alphabet = "ab'stmdrevlL  \n\t1²é!? '’  漢𝒜x"
    for _ in range(3000):
        s = "".join(r.choice(alphabet) for _ in range(r.randrange(14)))
        want = enc.enc.encode_ordinary(s)
        got = enc.encode(["q'", s, None, "'s"])
        assert got[1].tolist() == want and enc.counts(["q'", s, None, "'s"]).tolist() == [len(x) for x in got]


def test_blocks_and_hashes_dont_depend_on_place():
    words = ["alpha", "bêta", "x", "alpha"]
    h = {}
    for limit in (3, 10, 1000):
        got = []
        for _, _, cps, off in K.blocks(["-".join(words), None, "alpha"], limit):
            s, e, _ = K.word_spans(cps, off)
            got += K.span_hashes(cps, s, e).tolist()
        h[limit] = got
    assert h[3] == h[10] == h[1000] == K.word_hash([*words, "alpha"]).tolist()
    assert len(set(h[3])) == 3


def test_counts_equal_direct_encoding(spark):
    df = documents(spark)
    got = C.with_token_counts(df).orderBy("N").collect()
    enc = Encoder.get(VOCABULARY).enc
    assert [r["_n_tokens"] for r in got] == [None if t is None else len(enc.encode_ordinary(t)) for t in TEXTS]
    assert got[0]["n_tokens"] == "x" and C.with_token_counts(df.limit(0)).count() == 0
    table = C.frequent_table(df, size=5)
    assert len(table) == 5 and all(n == len(enc.encode_ordinary(t)) for t, n in table.items()) and table[" word"] == 1
    assert C.frequent_table(df.limit(0)) == {} and len(C.frequent_table(df.coalesce(1), rows=2)) < len(C.frequent_table(df))


def test_counts_with_any_table(spark):
    a, b = (C.with_token_counts(documents(spark), keep=["N"], table=t).orderBy("N").collect() for t in ({}, None))
    assert a == b


def test_table_counts_every_row(spark, monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(12_000)]
    lists = [r.choices(words[: 6000 if i < 400 else 12_000], k=60) for i in range(900)] + [["late"]] * 40
    want = Counter(t for x in lists for t in (x[0], *(f" {w}" for w in x[1:])))
    enc = Encoder.get(VOCABULARY).enc
    order = sorted((-n, t) for t, n in want.items() if n > 1)
    df = documents(spark, [" ".join(x) for x in lists] + [None, "", "y" * 65, "y" * 65]).coalesce(1)
    for held in (1_000_000, 5000, 0):  # a task's counts at once, in parts, and block by block
        monkeypatch.setattr(C, "TASK_WORDS", held, raising=False)
        for size in (C.TABLE_SIZE, 50):
            assert C.frequent_table(df, size=size) == {t: len(enc.encode_ordinary(t)) for _, t in order[:size]}
    assert len(order) > 8192 and (-40, "late") in order[:50]


def alike(n):
    """Two words of 2**n letters whose polynomial hashes modulo 2**64 are equal."""
    a = "".join("ab"[k.bit_count() % 2] for k in range(1 << n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_with_one_hash_keep_their_own_tokens(spark):
    enc = Encoder.get(VOCABULARY).enc
    for n in (11, 12):
        x, y = alike(n)
        assert len(set(K.word_hash([x, y]).tolist())) == 1
        own = Encoder(VOCABULARY)
        assert [i.tolist() for i in own.encode([f"{x} {y}", y, x])] == [enc.encode_ordinary(t) for t in (f"{x} {y}", y, x)]
        texts = [x, y, f"{x} q {y}", f"{y} q {x}"]
        assert own.counts(texts).tolist() == [len(enc.encode_ordinary(t)) for t in texts]
        df = documents(spark, texts)
        assert [r[1] for r in C.with_token_counts(df, keep=["N"]).orderBy("N").collect()] == [len(enc.encode_ordinary(t)) for t in texts]
        path = new_path(spark, "store")
        S.build(df, path)
        assert sorted((r.doc_id, r.ids) for r in S.read_documents(spark, path).collect()) == [(i, enc.encode_ordinary(t)) for i, t in enumerate(texts)]
        assert S.verify(spark, path).where("verified").count() == 4


def test_chunks_follow_content():
    r = np.random.default_rng(1)
    ids = r.integers(0, 50000, 20000).astype(np.uint32)
    ends = S.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 20000 and sizes.max() <= S.MOST and sizes[:-1].min() >= S.LEAST
    moved = S.cuts(np.concatenate([r.integers(0, 50000, 777).astype(np.uint32), ids]))
    assert len({e - 777 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert S.cuts(ids[:0]) == [] and S.cuts(ids[:5]) == [5] and S.cuts(np.zeros(5000, np.uint32))[-1] == 5000


def test_merkle_roots_tell_recipes_apart():
    names = [S.name_of(bytes([k])) for k in range(7)]
    roots = {S.merkle_root(names[:k]) for k in range(8)} | {S.merkle_root(names[::-1]), S.merkle_root([names[0], names[0]])}
    assert len(roots) == 10


def test_store_round_trip(spark):
    base = "lorem ipsum dolor sit amet " * 400
    texts = [*TEXTS, base, base, base + "tail", "head " + base]
    path = new_path(spark, "store")
    S.build(documents(spark, texts).repartition(3), path)
    enc = Encoder.get(VOCABULARY).enc
    back = sorted((r.doc_id, r.ids) for r in S.read_documents(spark, path).collect())
    assert back == [(i, enc.encode_ordinary(t or "")) for i, t in enumerate(texts)]
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("name").distinct().count()
    rows = {r.doc_id: r for r in S.verify(spark, path).collect()}
    assert all(r.verified for r in rows.values()) and rows[0].n_tokens is None and rows[1].n_chunks == 0 and rows[3].merkle_root == rows[7].merkle_root
    used = {x for r in rows.values() for x in r.recipe}
    assert len(used) == chunks.count() < sum(r.n_chunks for r in rows.values())


def test_a_damaged_store_is_noticed(spark):
    path = new_path(spark, "store")
    S.build(documents(spark), path)
    chunks = spark.read.parquet(f"{path}/chunks").toPandas()
    chunks.loc[0, "payload"] = b"xx"
    other = new_path(spark, "store")
    S.recipes(spark, path).selectExpr("'recipes' kind", "*").write.partitionBy("kind").parquet(f"{other}/staged")
    spark.createDataFrame(chunks.iloc[:-1], "name binary, payload binary").write.parquet(f"{other}/chunks")
    assert S.verify(spark, other).where("not verified").count() >= 1


def test_a_recipe_that_lacks_or_swaps_a_chunk_is_noticed(spark):
    path = new_path(spark, "store")
    S.build(documents(spark, [" ".join(f"w{k}" for k in range(4000))]), path)
    row = S.recipes(spark, path).first()
    assert len(row.recipe) > 2
    for recipe, size in ((row.recipe[:-1], row.n_tokens), ([row.recipe[1], row.recipe[0], *row.recipe[2:]], row.n_tokens), (row.recipe, row.n_tokens + 1)):
        other = new_path(spark, "store")
        bad = spark.createDataFrame([("recipes", 0, 0, size, row.digest, recipe, S.merkle_root([bytes(x) for x in recipe]))], S._schema(S.T.LongType())[:7])
        bad.write.partitionBy("kind").parquet(f"{other}/staged")
        spark.read.parquet(f"{path}/chunks").write.parquet(f"{other}/chunks")
        assert [r.verified for r in S.verify(spark, other).collect()] == [False]
    ids = np.random.default_rng(2).integers(0, 50000, 5000).astype(np.uint32)
    ends = np.array([0, 7, 7, 4000, 5000])

    def by_hand(x):
        out = []
        for p, b in zip(S.PRIMES, S.BASES):
            h = 0
            for i in x.tolist():
                h = (h * b + i + 1) % p
            out.append(h)
        return out

    parts = S.digests(ids, ends)
    assert parts.tolist() == [by_hand(x) for x in np.split(ids, ends)[:-1]]
    assert S.joined_digests(np.diff(ends, prepend=0), parts, np.array([0, 2, 5])).tolist() == [[0, 0], by_hand(ids[:7]), by_hand(ids[7:])]


def test_names_as_ids(spark):
    df = documents(spark).selectExpr("concat('d', doc_id) doc_id", "text", "text recipe")
    got = S.store_documents(df).collect()
    assert {r.doc_id for r in got} == {f"d{i}" for i in range(len(TEXTS))} and all(r.verified for r in got)


def test_empty_store(spark):
    assert S.store_documents(documents(spark).limit(0)).count() == 0


def test_least_squares_agree_with_brute_force():
    r = np.random.default_rng(5)
    import itertools

    for _ in range(20):
        a, b = r.integers(0, 3, (5, 4)).astype(float), r.integers(0, 9, 5).astype(float)
        x = P.nnls(a, b)
        best = np.inf
        for n in range(5):
            for on in itertools.combinations(range(4), n):
                s = np.linalg.lstsq(a[:, on], b, rcond=None)[0] if on else np.zeros(0)
                if (s >= -1e-9).all():
                    best = min(best, np.linalg.norm(a[:, on] @ s - b))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) == pytest.approx(best, abs=1e-6)


def test_patterns_fill_sequences_exactly():
    p = P.patterns(12, 3)
    assert (p @ np.arange(1, 13) == 12).all() and p.sum(1).max() == 3 and len({tuple(x) for x in p}) == len(p) == 19
    h = np.random.default_rng(2).integers(0, 50, 12)
    n = P.repeat_counts(h, p)
    assert (p.T @ n <= h).all() and (p.T @ n).sum() > 0


def brute_bins(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [(f, k) for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(capacity - n)
    return len(free)


def test_packing_against_best_fit(spark):
    r = np.random.default_rng(4)
    n = [int(x) for x in np.concatenate([r.lognormal(6, 1, 3000).astype(int), [0, 2048, 2049, 9000, 1]])]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(n)] + [(None, 5), (7, n[7]), (99999, None)], "doc_id long, n_tokens long")
    got = P.pack_lengths(table).toPandas()
    fill = P.check_fill(got)
    want = {}
    for i, x in [*enumerate(n), (7, n[7])]:
        want[i] = want.get(i, 0) + x
    have = got[got.doc_id.notna()].groupby("doc_id").n_tokens.sum()
    assert {int(k): int(v) for k, v in have.items()} == {k: v for k, v in want.items() if v} and got.doc_id.isna().sum() == 1
    whole = [x % 2048 or 2048 for x in n if x] + [2048] * sum((x - 1) // 2048 for x in n if x) + [5, n[7]]
    assert fill > 0.98 * got.n_tokens.sum() / 2048 / brute_bins(whole, 2048)
    assert sorted(got.groupby(["doc_id", "piece"]).size().unique()) == [1, 2]  # the repeated row is packed twice


def test_packing_texts_and_empty_tables(spark):
    got = P.pack(documents(spark)).toPandas()
    assert set(got.doc_id) == {2, 3, 4, 5, 6, 7} and P.check_fill(got) > 0
    assert P.pack(documents(spark).limit(0)).count() == 0 and P.pack(documents(spark, [None, ""])).count() == 0
