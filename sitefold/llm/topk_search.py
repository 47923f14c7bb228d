"""Exact top-k search by exhaustive term-at-a-time accumulation.

Scores are BM25 with whole-number impacts (thousandths, rounded half up), so sums don't depend on their order. Documents
become inverted blocks once (for each query term the documents and counts, in a written table); document frequencies and
lengths are counted over all of them. Then every block is scored: each sparse query row scatters its weighted postings
into a dense array, one term after another; the best k are selected by partition, merged within the task, and merged
over all tasks by a window that Spark limits before its shuffle. Queries go in chunks of QUERY_CHUNK rows, so what is
broadcast doesn't grow with their table.

Defined results: every row of queries is a query and every row of documents a document, repeated ones too; ids that aren't
whole numbers count as null; words are runs of letters and digits in lower case; null and empty texts match nothing and
count as documents of length 0; very long texts count whole; ties go to the lower doc_id, nulls last; fewer than k rows come
back where fewer documents share a word; empty tables give an empty table; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import new_path

TOP, K1, B = 10, 1.2, 0.75
QUERY_CHUNK = 4096
BLOCK_DOCS = 8192
_INTS, _LONGS = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.LongType(), True)
_BLOCK = T.StructType([T.StructField("ids", _LONGS), T.StructField("lengths", _INTS), T.StructField("terms", _INTS), T.StructField("starts", _INTS), T.StructField("docs", _INTS), T.StructField("tfs", _INTS)])


def _query_terms(texts: list[str | None]) -> list[dict[int, int]]:
    out: list[dict[int, int]] = [{} for _ in texts]
    for first, _, cps, offsets in K.blocks(K.lowered(texts)):
        s, e, doc = K.word_spans(cps, offsets)
        for d, h in zip(doc.tolist(), K.span_hashes(cps, s, e).tolist()):
            out[first + d][h] = out[first + d].get(h, 0) + 1
    return out


def _inverted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def one(ids, lengths, parts):
        doc, term, tf = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((doc, term))
        doc, term, tf = doc[order], term[order], tf[order]
        terms, starts = np.unique(term, return_index=True)
        lists = lambda x, t: pa.array([x], pa.list_(t))
        return pa.RecordBatch.from_arrays([lists(ids, pa.int64()), *(lists(np.asarray(x, np.int32), pa.int32()) for x in (np.concatenate(lengths), terms, np.append(starts, len(term)), doc, tf))], names=_BLOCK.names)

    def build(batches):
        known = sent.value
        ids, lengths, parts = [], [], []
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, end, cps, offsets in ((a + f, a + g, c, o) for a, t in K.slices(b.column(1)) for f, g, c, o in K.blocks(t)):
                s, e, doc = K.word_spans(cps, offsets)
                at = K.lookup(known, K.span_hashes(cps, s, e))
                pair, n = np.unique(doc[at >= 0] * len(known) + at[at >= 0], return_counts=True) if len(known) else (np.zeros(0, np.int64),) * 2
                parts.append((pair // max(len(known), 1) + len(ids), pair % max(len(known), 1), n))
                ids += keys[first:end]
                lengths.append(np.bincount(doc, minlength=end - first))
                if len(ids) >= BLOCK_DOCS:
                    yield one(ids, lengths, parts)
                    ids, lengths, parts = [], [], []
        if ids:
            yield one(ids, lengths, parts)

    return docs.mapInArrow(build, _BLOCK)


def _best(score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by score, then id with nulls last; only scores above 0."""
    at = np.flatnonzero(score)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((ids[at], null[at], -score[at]))[:k]]


def impacts(idf: np.ndarray, tf: np.ndarray, length: np.ndarray, mean: float, k1: float = K1, b: float = B) -> np.ndarray:
    return np.floor(idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean)) * 1000 + 0.5).astype(np.int64)


def _chunk(docs: DataFrame, queries: list[tuple[int, object, str | None]], top: int) -> DataFrame:
    """q, item_id, doc_id, score of the best of each task, for one chunk of queries."""
    spark = docs.sparkSession
    words = _query_terms([t for _, _, t in queries])
    vocabulary = np.array(sorted({h for w in words for h in w}), np.uint64)
    path = new_path(spark, "postings")
    _inverted(docs, vocabulary).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)
    n, total = blocks.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, mean = n or 0, (total or 0) / n if n and total else 1.0
    per_term = blocks.select(F.posexplode("terms").alias("i", "t"), "starts").groupBy("t").agg(F.sum(F.element_at("starts", F.col("i") + 2) - F.element_at("starts", F.col("i") + 1)).alias("df"))
    df = np.zeros(len(vocabulary))
    for r in per_term.collect():  # one row for each distinct word of the chunk
        df[r["t"]] = r["df"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    rows = [(q, np.searchsorted(vocabulary, np.array(list(w), np.uint64)), np.array(list(w.values()), np.int64)) for (q, _, _), w in zip(queries, words) if w]
    sent = spark.sparkContext.broadcast((rows, idf, mean))

    def search(batches):
        rows, idf, mean = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for b in batch.to_pylist():
                ids = np.array([0 if x is None else x for x in b["ids"]], np.int64)
                null = np.array([x is None for x in b["ids"]])
                terms, starts, docs_, tf = (np.array(b[c], np.int64) for c in ("terms", "starts", "docs", "tfs"))
                lengths = np.array(b["lengths"], np.int64)
                weight = impacts(np.repeat(idf[terms], np.diff(starts)), tf, lengths[docs_], mean)
                place = np.full(len(idf), -1, np.int64)
                place[terms] = np.arange(len(terms))
                for q, ts, counts in rows:
                    score = np.zeros(len(ids), np.int64)
                    for t, c in zip(place[ts].tolist(), counts.tolist()):
                        if t >= 0:
                            s, e = starts[t], starts[t + 1]
                            score[docs_[s:e]] += weight[s:e] * c  # a document is once in a list
                    at = _best(score, ids, null, top)
                    if not len(at):
                        continue
                    new = (score[at], ids[at], null[at])
                    if q in best:
                        new = tuple(np.concatenate(x) for x in zip(best[q], new))
                        keep = _best(*new, top)
                        new = tuple(x[keep] for x in new)
                    best[q] = new
        if best:
            q = np.repeat(np.array(list(best)), [len(x[0]) for x in best.values()])
            score, ids, null = (np.concatenate(x) for x in zip(*best.values()))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(score)], names=["q", "doc_id", "score"])

    found = blocks.mapInArrow(search, "q long, doc_id long, score long")
    names = spark.createDataFrame([(q, i) for q, i, _ in queries], "q long, item_id long")
    return found.join(F.broadcast(names), "q")


def top_k(docs: DataFrame, queries: DataFrame, top: int = TOP, chunk: int = QUERY_CHUNK) -> DataFrame:
    """item_id, rank, doc_id, score. docs: doc_id, text; queries: item_id, text."""
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    queries = queries.select(F.col("item_id").try_cast("long").alias("item_id"), "text")
    chunks = max(1, -(-queries.count() // chunk))
    parts, first = [], 0
    for c in range(chunks):
        mine = queries if chunks == 1 else queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c)
        rows = [(first + k, r[0], r[1]) for k, r in enumerate(mine.collect())]
        first += len(rows)
        if rows:
            parts.append(_chunk(docs, rows, top))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = functools.reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return every.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
size AS (SELECT count(*) AS n, sum(len(w)) / count(*)::DOUBLE AS mean FROM d),
q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, n AS len, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
impact AS (SELECT doc_id, tf.t, CAST(floor(ln(1 + ((SELECT n FROM size) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * {K1 + 1}::DOUBLE) / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * len / (SELECT mean FROM size))) * 1000 + 0.5) AS BIGINT) AS w FROM tf JOIN df USING (t)),
s AS (SELECT item_id, doc_id, CAST(sum(qtf * w) AS BIGINT) AS score FROM q JOIN impact USING (t) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
