"""Best-fit packing of documents into sequences of CAPACITY tokens, by length patterns.

Documents longer than a sequence are cut into whole sequences and a rest. Lengths are counted in units of CAPACITY /
UNITS tokens, rounded up. Every way to fill a sequence exactly with up to MOST pieces is a pattern; non-negative least
squares fits how often each is used to the histogram of lengths, with missing pieces weighing more than ones left over,
and the counts are rounded down. Pieces are numbered within their length by a seeded order, in parallel (per length and
shard of about SHARD pieces, with the shards' totals in front), so that a piece finds its pattern, repeat and place by
arithmetic. What the patterns leave, such as most of a corpus of short documents, is packed by best fit decreasing on the
true lengths, in parallel groups of about GROUP pieces.

Defined results: null and empty texts have no piece; repeated rows are packed each, and equal ones in any order among
themselves; very long texts have as many pieces as they need; a doc_id may be of any type; an empty table gives an empty
table; other columns of the input don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, small_or_shuffled
from .token_counts import with_token_counts
from .tokenizer import VOCABULARY

CAPACITY = 2048
UNITS = 128
MOST = 4
SHARD = 1_000_000
GROUP = 20_000
RESIDUAL = 1 << 60


def patterns(units: int = UNITS, most: int = MOST) -> np.ndarray:
    """All multisets of up to `most` lengths that add up to `units`, as counts by length (row: pattern)."""
    rows = []

    def add(left, largest, got):
        if not left:
            rows.append(tuple(got))
        elif len(got) < most:
            for x in range(min(left, largest), 0, -1):
                if x * (most - len(got)) < left:
                    break
                add(left - x, x, [*got, x])

    add(units, units, [])
    out = np.zeros((len(rows), units + 1), np.int64)
    for k, r in enumerate(rows):
        for x in r:
            out[k, x] += 1
    return out[:, 1:]


def nnls(a: np.ndarray, b: np.ndarray, passes: int | None = None) -> np.ndarray:
    """x >= 0 with the least |ax - b|, by Lawson and Hanson's active sets."""
    m, n = a.shape
    x, on = np.zeros(n), np.zeros(n, bool)
    limit = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(passes or 5 * m + 50):
        at = np.flatnonzero(on)
        w = a.T @ (b - a[:, at] @ x[at])
        w[at] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= limit:
            break
        on[k] = True
        while True:
            at = np.flatnonzero(on)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 1e-12).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 1e-12
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300))
            x[at] += np.clip(step, 0, 1) * (s - x[at])
            on[at[x[at] <= 1e-12]] = False
            x[~on] = 0
            if not on.any():
                break
    return x


def repeat_counts(histogram: np.ndarray, pat: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Whole repeats of each pattern that the histogram can serve. The fit is repeated on what rounding and the weights left."""
    left = histogram.astype(np.int64).copy()
    total = np.zeros(len(pat), np.int64)
    for _ in range(rounds):
        if not left.sum():
            break
        short = np.where(left > 0, 1.0, 8.0)  # a pattern mustn't ask for lengths that aren't there
        x = nnls((pat * short).T.astype(float), left * short)
        took = 0
        for k in np.argsort(-x, kind="stable"):
            need = pat[k]
            n = min(int(x[k] + 1e-6), int((left[need > 0] // need[need > 0]).min()))
            if n > 0:
                total[k] += n
                left -= n * need
                took += n
        if not took:
            break
    return total


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece: longest first, each into the fullest bin that still takes it."""
    import bisect

    rooms: list[tuple[int, int]] = []  # free tokens and bin, sorted
    bins, offsets, n = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = bisect.bisect_left(rooms, (lengths[i], -1))
        if at < len(rooms):
            free, b = rooms.pop(at)
        else:
            free, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - free
        if free > lengths[i]:
            bisect.insort(rooms, (free - lengths[i], b))
    return bins, offsets


def pieces(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, n_tokens: whole sequences of long documents, and rests."""
    n = F.ceil(F.col("n_tokens") / capacity).cast("int")
    split = counted.where("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("_all"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return split.select("doc_id", "piece", F.least(F.lit(capacity), F.col("_all") - F.col("piece") * capacity).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY, units: int = UNITS, most: int = MOST, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, bin_offset of every piece of every document."""
    only = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return pack_lengths(with_token_counts(only, "text", "n_tokens", vocabulary, keep=["doc_id"]), capacity, units, most)


def pack_lengths(counted: DataFrame, capacity: int = CAPACITY, units: int = UNITS, most: int = MOST) -> DataFrame:
    """The same for a table of doc_id, n_tokens."""
    spark = counted.sparkSession
    unit = capacity // units
    every = cut(pieces(counted, capacity).withColumn("u", F.ceil(F.col("n_tokens") / unit).cast("int")))
    shards = max(8, every.count() // SHARD)
    sharded = every.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(3)), F.lit(shards)).cast("int"))
    totals = cut(sharded.groupBy("u", "shard").agg(F.count("*").alias("n")))
    histogram = np.zeros(units, np.int64)
    for r in totals.groupBy("u").agg(F.sum("n").alias("n")).collect():  # as many rows as units
        histogram[r["u"] - 1] = r["n"]
    # a whole sequence is its own pattern; the fit is for the others
    pat = patterns(units, most)
    alone = np.flatnonzero(pat[:, units - 1] == 1)
    rest = histogram.copy()
    rest[units - 1] = 0
    count = repeat_counts(rest, pat)
    count[alone] = histogram[units - 1]
    # a piece's number within its length tells its pattern: ranges of numbers, laid end to end, by pattern and place
    ranges, first_bin = [], 0
    used = np.zeros(units, np.int64)
    for k in np.flatnonzero(count):
        place = 0
        for x in range(units, 0, -1):
            for _ in range(int(pat[k, x - 1])):
                ranges.append((x, int(used[x - 1]), int(used[x - 1] + count[k]), first_bin, place))
                used[x - 1] += count[k]
                place += 1
        first_bin += int(count[k])
    before = F.sum("n").over(Window.partitionBy("u").orderBy("shard")) - F.col("n")
    starts = small_or_shuffled(totals.select("u", "shard", before.alias("start")), rows=units * shards)
    number = F.row_number().over(Window.partitionBy("u", "shard").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "n_tokens")) - 1
    numbered = sharded.join(starts, ["u", "shard"]).select("doc_id", "piece", "n_tokens", F.col("u"), (F.col("start") + number).alias("r"))
    table = F.broadcast(spark.createDataFrame(ranges, "u int, low long, high long, bin long, place int"))
    # lengths have few ranges each; the range join is a hash join on the length with a filter
    placed = numbered.join(table, (numbered.u == table.u) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high")), "left").select("doc_id", "piece", "n_tokens", "r", (F.col("bin") + F.col("r") - F.col("low")).alias("bin_id"), "place")
    placed = cut(placed)
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("bin_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fitted = placed.where("bin_id is not null").select("doc_id", "piece", "n_tokens", "bin_id", before.cast("int").alias("bin_offset"))
    left = placed.where("bin_id is null")
    groups = max(1, int(histogram.sum() - used.sum()) // GROUP)

    def residual(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ignore_index=True)
        b, o = best_fit(pdf.n_tokens.tolist(), capacity)
        return pd.DataFrame({"doc_id": pdf.doc_id, "piece": pdf.piece, "n_tokens": pdf.n_tokens, "bin_id": RESIDUAL + pdf.g.astype("int64") * (1 << 32) + np.array(b, np.int64), "bin_offset": np.array(o, np.int64)})

    spread = left.select("doc_id", "piece", "n_tokens", F.pmod(F.xxhash64("doc_id", "piece", F.lit(4)), F.lit(groups)).cast("int").alias("g"))
    rest = spread.groupBy("g").applyInPandas(residual, T.StructType([counted.schema["doc_id"], *T.StructType.fromDDL("piece int, n_tokens int, bin_id long, bin_offset int")]))
    return fitted.unionByName(rest)


def check_fill(packed: pd.DataFrame, capacity: int = CAPACITY) -> float:
    """The share of the sequences' tokens that are used; raises if pieces overlap or stick out."""
    rows = packed.sort_values(["bin_id", "bin_offset"])
    end = (rows.bin_offset + rows.n_tokens).to_numpy()
    nxt = np.where(rows.bin_id.to_numpy()[1:] == rows.bin_id.to_numpy()[:-1], rows.bin_offset.to_numpy()[1:], capacity)
    if len(end) and ((end > capacity).any() or (end[:-1] > nxt).any() or (rows.bin_offset < 0).any()):
        raise ValueError("pieces overlap")
    return float(rows.n_tokens.sum() / (capacity * max(1, rows.bin_id.nunique())))
