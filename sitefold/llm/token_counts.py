"""Token counts: a broadcast table of frequent pre-token lengths, and worker caches for the rest.

The table is a hash table from pre-token to its length in tokens, of at most TABLE_SIZE entries: the most frequent pre-tokens
of all rows, counted whole in a pass before the one that counts tokens. Each task adds up its own before they are shuffled by
pre-token, however rare. The table only saves work: misses are encoded once in each worker, and both tiers compare the
pre-token itself, so counts are exact with any table.

Defined results: a null text has a null count, an empty one 0; repeated rows are counted each; very long texts are counted
whole; of equally frequent pre-tokens the first in order is in the table, which changes no count; an empty table gives an
empty table with the same columns; a column of the input that has the output's name is kept and the new one gets an
underscore in front.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import cut, free_name
from .tokenizer import VOCABULARY, Encoder

#: Entries of the table and their characters, at most; pre-tokens that a task adds up at once, about.
TABLE_SIZE, TABLE_WORD, TASK_WORDS = 65_536, 64, 1_000_000


def frequent_table(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, rows: int | None = None, size: int = TABLE_SIZE) -> dict[str, int]:
    """Token lengths of the pre-tokens that come twice or more in all rows (or in the first `rows` of every partition); the most
    frequent ones."""
    def added(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("p", use_threads=False).aggregate([("n", "sum")]).rename_columns(["p", "n"])

    def count(batches):
        pending, held, left = [], 0, rows
        for b in batches:
            column = b.column(0) if left is None else b.column(0).slice(0, left)
            for _, texts in K.slices(column, lower=False):
                for _, _, cps, offsets in K.blocks(texts):
                    found = K.distinct_spans(cps, K.pretoken_spans(cps, offsets)[0])
                    n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                    pending.append(pa.table([found.dictionary, pa.array(n, pa.int64())], names=["p", "n"]).filter(pc.less_equal(pc.utf8_length(found.dictionary), TABLE_WORD)))
                    held += len(pending[-1])
                    if held > TASK_WORDS:
                        pending = [added(pending)]
                        held = len(pending[0])
                        if held > TASK_WORDS // 2:
                            yield from pending[0].to_batches()
                            pending, held = [], 0
            if left is not None and (left := left - len(column)) <= 0:
                break
        if pending:
            yield from added(pending).to_batches()

    counted = cut(df.select(text).mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).where("n > 1"))
    # how many come how often tells which are in, so no more than the table reaches the driver
    often = counted.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    whole = often.words.cumsum() <= size
    least = int(often.n[~whole].max()) if not whole.all() else 0
    last = counted.where(F.col("n") == least).orderBy("p").limit(size - int(often.words[whole].sum()))
    found = counted.where(F.col("n") > least).union(last).select("p").toPandas()
    enc = Encoder.get(vocabulary).enc
    return dict(zip(found.p, map(len, enc.encode_ordinary_batch(found.p.tolist(), num_threads=1))))


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY, keep: list[str] | None = None, table: dict[str, int] | None = None) -> DataFrame:
    """df's columns (or those in keep), and the number of tokens of each text."""
    spark = df.sparkSession
    table = frequent_table(df, text, vocabulary) if table is None else table
    sent = spark.sparkContext.broadcast(table)
    names = df.columns if keep is None else keep
    name, given = free_name(names, out), free_name(names, "_counted_text")
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(name, T.LongType())])

    def count(batches):
        encoder = Encoder.get(vocabulary)
        known = sent.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            n = np.concatenate([np.zeros(0, np.int64), *(encoder.counts(t, known) for _, t in K.slices(texts, lower=False))])
            counted = pa.array(n, pa.int64(), mask=np.asarray(texts.is_null()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], counted], names=[*names, name])

    return df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").alias(given)).mapInArrow(count, schema)
