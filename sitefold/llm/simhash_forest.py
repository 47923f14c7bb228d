"""Near-duplicates by SimHash and an LSH forest.

Fingerprint: 256 signs of the summed hashes of a text's distinct word pairs (single words in one-word texts), in lower
case; 8 bits at a time through byte histograms. Texts without a word get a fingerprint of their raw characters, so that
equal ones still fall together. Equal fingerprints are one node, so copies add nothing.

Forest: each trie orders the nodes by another random permutation of the bits. Its upper part is shuffled, its lower part
is local. A branch of the upper part ends at START bits, and deeper only where it holds more than BRANCH nodes; a node enters tries until a pair of it at
the farthest accepted distance shares a branch in one of them with probability RECALL, so that only nodes of dense branches
need more tries than the others, and rows shuffled follow the number of nodes. Below a branch lies a forest of its own, in
one task's memory: several tries over other permutations, whose branches split while they hold more than LEAF nodes. From
the deepest prefixes they climb to the depth at which that many tries reach LOCAL_RECALL; of the pairs (tries, depth) that
do, the one with the least work at the branch's own measured density is taken. In each leaf nodes are compared on the full
fingerprint, and a pair at Hamming distance of at most DISTANCE is verified.

Nothing is capped: a leaf of any size is worked through exactly. In a large one a pivot is linked to all nodes in reach; those
within half the distance need then only be compared with what lies between once and one and a half times the distance from it, and go. So a large
group of near copies costs few passes, not all its pairs. Groups are the connected components of the verified pairs.

Defined results: a null text is never a duplicate and is its own group; empty texts are copies of each other, as are
equal texts without words; very long texts count whole; the kept row of a group is the one with the lowest doc_id (nulls
last), of rows equal in that just one; repeated rows are copies; an empty table gives an empty table; all other columns
stay, whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import cut, free_name, new_path, small_or_shuffled

BITS = 256
WORDS = BITS // 64
#: Two texts of which a fifth of the bits differ share about three quarters of their word pairs.
DISTANCE = 52
#: For pairs at just this distance; closer ones are found more often.
RECALL, LOCAL_RECALL = 0.9, 0.95
SEED = 20240607
#: Bits of a branch, at least and at most, and the nodes above which it is split.
START, END, BRANCH = 6, 12, 1_000_000
LEAF, BLOCK = 32, 2048
#: Microseconds of a node in a local trie and of a comparison.
NODE_COST, PAIR_COST = 0.4, 0.02
U64 = np.uint64
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32) * 2 - 1)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """WORDS numbers of 64 bits for each text."""
    out = np.zeros((len(texts), WORDS), U64)
    for first, end, cps, offsets in K.blocks(K.lowered(texts)):
        n = end - first
        s, e, doc = K.word_spans(cps, offsets)
        h = K.span_hashes(cps, s, e)
        words = np.bincount(doc, minlength=n)
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        single = np.flatnonzero(words[doc] == 1) if len(doc) else np.zeros(0, np.int64)
        f = np.concatenate([K.mix(h[pair] * U64(0x9FB21C651E98DF25) ^ h[pair + 1]), h[single]])
        d = np.concatenate([doc[pair], doc[single]])
        # each feature once a text: sorted by a key of text and feature
        key = np.sort((f >> U64(20)) | (d.astype(U64) << U64(44)))  # an Arrow batch has far fewer than 2**20 texts
        if len(key):
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            key = key[new]
        d = (key >> U64(44)).astype(np.int64)
        f = key & U64((1 << 44) - 1)
        for half in range(WORDS):
            x = K.mix(f + U64(0xA0761D6478BD642F * (half + 1) & (2**64 - 1)))
            bits = np.zeros((n, 64), bool)
            for byte in range(8):
                at = d * 256 + ((x >> U64(8 * byte)) & U64(255)).astype(np.int64)
                counts = np.bincount(at, minlength=n * 256).reshape(n, 256).astype(np.float32)
                bits[:, 8 * byte : 8 * byte + 8] = counts @ _SIGNS > 0
            out[first:end, half] = np.packbits(bits, axis=1, bitorder="little").view(U64).ravel()
        for k in np.flatnonzero(words == 0):
            t = texts[first + k] or ""
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            x = K.span_hashes(c, np.array([0]), np.array([len(c)])) if len(c) else np.array([7], U64)
            out[first + k] = [K.mix(x + U64(w))[0] for w in range(WORDS)]
    return out


_FIELDS = ("node", *(f"f{k}" for k in range(WORDS)))


def node_ids(fp: np.ndarray) -> np.ndarray:
    """A number for each fingerprint; it follows from the bits, so a lost partition comes back the same."""
    h = K.mix(fp[:, 0])
    for k in range(1, WORDS):
        h = K.mix(h * U64(0x9FB21C651E98DF25) ^ fp[:, k])
    return h.view(np.int64)


def with_fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """df's columns (or those in keep), the node and the words of the fingerprint, null for null texts; and these columns' names."""
    kept = df.columns if keep is None else keep
    names = []
    for x in _FIELDS:
        names.append(free_name([*kept, *names], x))
    given = free_name([*kept, *names], "_hashed_text")
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(x, T.LongType()) for x in names)])

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            parts = [fingerprints(t) for _, t in K.slices(texts, lower=False)]
            fp, null = np.concatenate([np.zeros((0, WORDS), U64), *parts]), np.asarray(texts.is_null())
            new = [pa.array(x, pa.int64(), mask=null) for x in (node_ids(fp), *np.ascontiguousarray(fp.T).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*kept, *names])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias(given)).mapInArrow(run, schema), names


def shared_prefix(depth: int, distance: int = DISTANCE, bits: int = BITS) -> float:
    """The probability that a pair at a distance shares a prefix of a random permutation; bits are drawn without replacement."""
    return math.comb(bits - distance, depth) / math.comb(bits, depth) if depth <= bits - distance else 0.0


def tries_for(depth: int, distance: int = DISTANCE, recall: float = RECALL, found: float = LOCAL_RECALL) -> int:
    """Tries of branches of that depth by which a pair at this distance is found, if its branch finds it with probability `found`."""
    p = shared_prefix(depth, distance) * found
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-p))) if p < 1 else 1


@functools.cache
def depth_for(tries: int, distance: int, recall: float, bits: int) -> int:
    """Climbs from deep prefixes to the first at which so many tries reach the recall; 0 finds every pair."""
    for depth in range(48, 0, -1):
        if 1 - (1 - shared_prefix(depth, distance, bits)) ** tries >= recall:
            return depth
    return 0


@functools.cache
def permutation(trie: int) -> np.ndarray:
    return np.random.default_rng([SEED, trie]).permutation(BITS)


def prefixes(fp: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` bits in that order of each fingerprint, as numbers."""
    out = np.zeros(len(fp), np.int64)
    for b in order[:depth].tolist():
        out = out << 1 | ((fp[:, b // 64] >> U64(b % 64)) & U64(1)).astype(np.int64)
    return out


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    far = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.uint16)
    for k in range(1, WORDS):
        far += np.bitwise_count(x[..., k] ^ y[..., k])
    return far


def close_pairs(fp: np.ndarray, distance: int = DISTANCE, step: int = 512):
    """Index pairs i < j at most `distance` apart, block by block."""
    n = len(fp)
    for a in range(0, n, step):
        for b in range(a, n, step):
            i, j = np.nonzero(_far(fp[a : a + step, None], fp[None, b : b + step]) <= distance)
            ok = i + a < j + b
            yield i[ok] + a, j[ok] + b


def linked(fp: np.ndarray, distance: int = DISTANCE):
    """Index pairs at most `distance` apart that connect what close_pairs() connects, without all pairs of a dense group."""
    left = np.arange(len(fp))
    while len(left) > BLOCK:
        p, rest = left[0], left[1:]
        far = _far(fp[p][None], fp[rest])
        near = rest[far <= distance]
        yield np.full(len(near), p), near
        core, shell = rest[far <= distance // 2], rest[(far > distance) & (far <= distance + distance // 2)]
        # a node of the core reaches nothing farther than the shell from the pivot, and is one with the core already
        for k in range(0, len(core), BLOCK):
            if not len(shell):
                break
            some = core[k : k + BLOCK]
            hit = np.zeros(len(shell), bool)
            for m in range(0, len(shell), BLOCK):
                i, j = np.nonzero(_far(fp[shell[m : m + BLOCK], None], fp[None, some]) <= distance)
                first = np.unique(i, return_index=True)[1]
                yield shell[m + i[first]], some[j[first]]
                hit[m + i] = True
            shell = shell[~hit]
        left = rest[far > distance // 2]
    for i, j in close_pairs(fp[left], distance):
        yield left[i], left[j]


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The lowest index of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _star(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the lowest index of each component to its others; as many components as by i-j, at most one edge a node."""
    u, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    root = _labels(at[: len(i)], at[len(i) :], len(u))
    other = root != np.arange(len(u))
    return u[root[other]], u[other]


def leaves(codes: np.ndarray, depth: int, most: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a trie's leaves in its sorted codes of so many bits: branches split while they hold more than `most`."""
    starts, ends = np.array([0]), np.array([len(codes)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, depth + 1):
        small = ends - starts <= most
        found.append((starts[small], ends[small]))
        starts, ends = starts[~small], ends[~small]
        if not len(starts):
            break
        # the first code of the upper half of each branch
        half = (codes[starts] >> (depth - k + 1) << 1 | 1) << (depth - k)
        at = np.clip(np.searchsorted(codes, half), starts, ends)
        starts, ends = np.concatenate([starts, at]), np.concatenate([at, ends])
        there = ends > starts
        starts, ends = starts[there], ends[there]
    found.append((starts, ends))
    starts, ends = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(starts)
    return starts[order], ends[order]


def _pairs_within(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, distance: int, all_pairs: bool):
    """Verified pairs in ranges of fp, small ones many together."""
    size = ends - starts
    for m in np.unique(size[(size > 1) & (size <= 64)]).tolist():
        every, upper = starts[size == m], np.triu_indices(m, 1)
        step = max(1, 1_000_000 // (m * m))
        for k in range(0, len(every), step):
            at = every[k : k + step, None] + np.arange(m)
            x, y = at[:, upper[0]].ravel(), at[:, upper[1]].ravel()
            ok = _far(fp[x], fp[y]) <= distance
            if ok.any():
                yield x[ok], y[ok]
    for s, e in zip(starts[size > 64].tolist(), ends[size > 64].tolist()):
        for i, j in close_pairs(fp[s:e], distance) if all_pairs else linked(fp[s:e], distance):
            if len(i):
                yield i + s, j + s


def plan_branch(fp: np.ndarray, distance: int = DISTANCE, recall: float = LOCAL_RECALL) -> tuple[int, int]:
    """(tries, depth) with the least work below a branch, at its own density: nodes under each prefix of 16 bits."""
    m, best = len(fp), (len(fp) ** 2 / 2 * PAIR_COST, 1, 0)
    if m <= 256:
        return best[1:]
    sizes = np.bincount(prefixes(fp, permutation(10_000), 16), minlength=1 << 16).astype(float)
    tries = 1
    while tries <= 512:
        depth = depth_for(tries, distance, recall, BITS)
        if depth:
            of = sizes.reshape(1 << min(depth, 16), -1).sum(1)
            work = tries * (m * NODE_COST + (of**2).sum() / 2 / 2.0 ** max(0, depth - 16) * PAIR_COST)
            best = min(best, (work, tries, depth))
        tries = tries + 1 if tries < 8 else tries * 5 // 4
    return best[1:]


def branch_links(fp: np.ndarray, distance: int = DISTANCE, all_pairs: bool = False, recall: float = LOCAL_RECALL) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs below a branch: verified ones, without all_pairs just enough to connect what they connect."""
    tries, depth = plan_branch(fp, distance, recall)
    a, b, size = [], [], 0
    for t in range(tries):
        order, codes = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        if depth:
            codes = prefixes(fp, permutation(10_001 + t), depth)
            order = np.argsort(codes, kind="stable")
        for i, j in _pairs_within(fp[order], *leaves(codes[order], depth), distance, all_pairs):
            a.append(order[i])
            b.append(order[j])
            size += len(i)
        if size > 1_000_000 and not all_pairs:
            i, j = _star(np.concatenate(a), np.concatenate(b))
            a, b, size = [i], [j], 0
    if not a:
        e = np.zeros(0, np.int64)
        return e, e
    i, j = np.concatenate(a), np.concatenate(b)
    return (i, j) if all_pairs else _star(i, j)


def branch_depths(counts: np.ndarray, most: int = BRANCH) -> np.ndarray:
    """For each prefix of END bits the depth at which its branch ends, from the nodes under each."""
    out = np.full(1 << END, END, np.int64)
    for k in range(END - 1, START - 1, -1):
        small = counts.reshape(1 << k, -1).sum(1) <= most
        out = np.where(np.repeat(small, 1 << (END - k)), k, out)
    return out


def entries(fp: np.ndarray, depths: list[np.ndarray], distance: int = DISTANCE, recall: float = RECALL):
    """For each trie its nodes (as indices) and their branches' keys. A node leaves once its tries reach the recall."""
    missed = np.ones(len(fp))
    p = np.array([shared_prefix(k, distance) * LOCAL_RECALL for k in range(END + 1)])
    for t, depth in enumerate(depths):
        inside = np.flatnonzero(missed > 1 - recall + 1e-12)
        if not len(inside):
            return
        codes = prefixes(fp[inside], permutation(t), END)
        k = depth[codes]
        missed[inside] *= 1 - p[k]
        yield inside, (t << (END + 2)) | (1 << k) | (codes >> (END - k))


def plan_tries(nodes: DataFrame, distance: int = DISTANCE, recall: float = RECALL, most: int = BRANCH) -> list[np.ndarray]:
    """branch_depths() of each trie."""

    def counted(tries):
        def count(batches):
            total = np.zeros((tries, 1 << END), np.int64)
            for b in batches:
                fp = np.stack([c.to_numpy().view(U64) for c in b.columns], 1)
                for t in range(tries):
                    total[t] += np.bincount(prefixes(fp, permutation(t), END), minlength=1 << END)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["at", "n"])

        found = nodes.select(*_FIELDS[1:]).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(tries << END, np.int64)
        total[found["at"]] = found["n"]
        return [branch_depths(x, most) for x in total.reshape(tries, -1)]

    tries = tries_for(START, distance, recall)
    if nodes.count() <= most:
        return [np.full(1 << END, START, np.int64)] * tries
    depths = counted(tries)
    deepest = max(int(x.max()) for x in depths)
    return depths if deepest == START else counted(tries_for(deepest, distance, recall))


def verified_edges(nodes: DataFrame, depths: list[np.ndarray], distance: int = DISTANCE, all_pairs: bool = False, recall: float = RECALL) -> DataFrame:
    """a, b: node ids of verified pairs of the tries' branches; without all_pairs just enough of them to connect each component.
    nodes: node and the words of its fingerprint."""
    sent = nodes.sparkSession.sparkContext.broadcast(depths)

    def spread(batches):
        for b in batches:
            fp = np.stack([c.to_numpy().view(U64) for c in b.columns], 1)
            for inside, key in entries(fp, sent.value, distance, recall):
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.take(pa.array(inside)).columns], names=["p", *_FIELDS[1:]])

    def done(parts):
        fp = np.concatenate(parts)
        i, j = branch_links(fp, distance, all_pairs)
        if len(i):
            node = node_ids(fp)
            x, y = node[i], node[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def compare(batches):
        now, parts = None, []
        for b in batches:
            p = b.column(0).to_numpy()
            fp = np.stack([c.to_numpy().view(U64) for c in b.columns[1:]], 1)
            edges = np.flatnonzero(np.diff(p, prepend=p[:1] - 1)) if len(p) else []
            for s, e in zip(edges, [*edges[1:], len(p)]):
                if now is not None and p[s] != now:
                    yield from done(parts)
                    parts = []
                now = p[s]
                parts.append(fp[s:e])
        if parts:
            yield from done(parts)

    keyed = nodes.select(*_FIELDS[1:]).mapInArrow(spread, ", ".join(f"{x} long" for x in ("p", *_FIELDS[1:])))
    return keyed.repartition("p").sortWithinPartitions("p").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's lowest node) of every node with an edge. Alternates large and small stars: each pass
    joins every node to the lowest one in reach, and pointers halve; passes are logarithmic in the longest chain."""
    now = cut(edges.where("a <> b").distinct())
    size = now.count()
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each neighbour hangs on the lowest of the neighbourhood (large star), then lower ones hang together (small star)
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").union(low.where("m < u").select(F.col("m"), F.col("u"))).distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        nxt = cut(large.join(down, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct())
        before, size = size, nxt.count()
        same = size == before and nxt.exceptAll(now).isEmpty()
        now = nxt
        if same:
            return now.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")


def roots(fps: DataFrame, distance: int = DISTANCE, recall: float = RECALL) -> DataFrame | None:
    """node, root: nodes that others are joined to, of the table of fingerprints; None if it has just one."""
    nodes = cut(fps.where("node is not null").groupBy("node").agg(*(F.first(x).alias(x) for x in _FIELDS[1:])))
    if nodes.count() < 2:
        return None
    return components(verified_edges(nodes, plan_tries(nodes, distance, recall), distance, recall=recall))


def grouped(fps: DataFrame, distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """The rows of fps (a table with node, the words of the fingerprint, and others) with root, the same number for all rows of a group."""
    found = roots(fps, distance, recall)
    if found is None:
        return fps.withColumn("root", F.col("node"))
    side = cut(found.select(F.col("node").alias("_n"), "root"))
    joined = fps.join(small_or_shuffled(side), F.col("node") == F.col("_n"), "left")
    return joined.withColumn("root", F.coalesce("root", "node")).drop("_n")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """doc_id, group_id, group_size, links, kept of every row: group_id is the lowest doc_id of the row's group (null if it has
    none), links the number of the group's other rows."""
    one, _ = with_fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", ["doc_id"])
    fps = cut(one)
    every = grouped(fps.where("node is not null"), distance, recall)
    alone = fps.where("node is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("kept"))
    by = Window.partitionBy("root")
    done = every.select("root", "doc_id").select(
        "doc_id", F.min("doc_id").over(by).alias("group_id"), F.count("*").over(by).alias("group_size"), (F.count("*").over(by) - 1).alias("links"), (F.row_number().over(by.orderBy(F.col("doc_id").asc_nulls_last())) == 1).alias("kept")
    )
    return done.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """The rows of docs of which one stays of each group, with all their columns. The rows are written once with a number
    each, so that the decision, made on numbers alone, finds its row; texts move only if the list of dropped rows is long."""
    names = docs.columns
    row = free_name(names, "_row")
    marked, new = with_fingerprints(docs, text)
    path = new_path(docs.sparkSession, "neardup")
    marked.withColumn(row, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    fps = stored.select(F.col(row).alias("n"), F.col(f"`{doc_id}`").alias("doc_id"), *(F.col(a).alias(b) for a, b in zip(new, _FIELDS))).where("node is not null")
    order = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "n")
    ranked = grouped(fps, distance, recall).select("root", "doc_id", "n").select("n", F.row_number().over(order).alias("k"))
    dropped = cut(ranked.where("k > 1").select(F.col("n").alias("_dropped")))
    return stored.join(small_or_shuffled(dropped), F.col(row) == F.col("_dropped"), "left_anti").select(*(F.col(f"`{c}`") for c in names))
