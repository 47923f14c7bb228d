"""A content-addressed store of token ids.

A rolling hash over the last WINDOW ids cuts each document's id stream into chunks wherever its low bits are all set, so
equal passages get equal chunks wherever they stand; no chunk is shorter than LEAST ids (but for a document's last one)
or longer than MOST. A chunk is named by the BLAKE2b of its bytes and stored once. A document's recipe lists its chunks'
names; its Merkle root is over them, its digest over the whole id stream. Chunks move once: each task drops its own repeats,
the names alone (not the bytes) are shuffled to find repeats between tasks, and the store is written without those.

verify() recomputes every chunk's name from its stored bytes, every root from its recipe, and each document's length and
digest from those of the stored chunks in the recipe's order: the digest is a pair of polynomials modulo primes, so that of
a stream follows from those of its parts, and no bytes move. read_documents() gives the ids back.

Defined results: null and empty texts have an empty recipe and the root of nothing, a null text has null n_tokens;
repeated rows have a recipe each and share their chunks; very long texts are cut whole; a doc_id may be of any type; an empty
table gives an empty store; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import new_path, remove, small_or_shuffled
from .tokenizer import VOCABULARY, Encoder

WINDOW, MASK_BITS, LEAST, MOST = 16, 8, 64, 1024
_GEAR = K.mix(np.arange(1 << 18, dtype=np.uint64) + np.uint64(0x51ED270B))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h, k = _GEAR[ids & 0x3FFFF], 1
    while k < WINDOW:  # sums over 1, 2, 4, ... ids, each doubled once for every id after it
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint64(k)
        h, k = longer, 2 * k
    # the high bits hold all of the window
    marks = np.flatnonzero((h >> np.uint64(WINDOW)) & np.uint64((1 << MASK_BITS) - 1) == (1 << MASK_BITS) - 1) + 1
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n and m > last:
            out.append(m)
            last = m
    return out


def name_of(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


PRIMES, BASES = (2147483629, 2147483587), (1000003, 998244353)


def powers(k: int, exponents: np.ndarray) -> np.ndarray:
    """BASES[k] to the power of each exponent, modulo PRIMES[k]."""
    p, out = np.uint64(PRIMES[k]), np.ones(len(exponents), np.uint64)
    left, base = exponents.astype(np.uint64), BASES[k]
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(base) % p, out)
        left, base = left >> np.uint64(1), base * base % PRIMES[k]
    return out


_tables: dict[int, np.ndarray] = {}


def digests(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials modulo PRIMES of id streams that lie one after another, the first id with the highest power (columns: primes)."""
    size = np.diff(ends, prepend=0)
    out = np.zeros((len(ends), len(PRIMES)), np.int64)
    most = int(size.max(initial=0))
    there = np.flatnonzero(size)
    if not len(there):
        return out
    # ids that follow in the same stream
    after = np.repeat(ends, size) - 1 - np.arange(len(ids))
    for k, p in enumerate(PRIMES):
        if k not in _tables or len(_tables[k]) < most:
            _tables[k] = powers(k, np.arange(max(most, MOST + 1)))
        terms = (ids.astype(np.uint64) + np.uint64(1)) * _tables[k][after] % np.uint64(p)
        out[there, k] = np.add.reduceat(terms, (ends - size)[there]) % np.uint64(p)
    return out


def joined_digests(size: np.ndarray, parts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The digests of streams whose parts lie one after another, from the parts' lengths and digests."""
    count = np.diff(ends, prepend=0)
    out = np.zeros((len(ends), len(PRIMES)), np.int64)
    there = np.flatnonzero(count)
    if not len(there):
        return out
    total = np.concatenate([[0], np.cumsum(size)])
    after = np.repeat(total[ends], count) - total[1:]
    for k, p in enumerate(PRIMES):
        terms = parts[:, k].astype(np.uint64) * powers(k, after) % np.uint64(p)
        out[there, k] = np.add.reduceat(terms, (ends - count)[there]) % np.uint64(p)
    return out


def merkle_root(names: list[bytes]) -> bytes:
    """Root of a binary hash tree; inner nodes and leaves are told apart by a first byte, an odd node goes up as it is."""
    level = [name_of(b"\0" + x) for x in names] or [name_of(b"\0")]
    while len(level) > 1:
        level = [name_of(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def _schema(id_type: T.DataType) -> T.StructType:
    rest = T.StructType.fromDDL("n_tokens long, digest array<long>, recipe array<binary>, root binary, name binary, payload binary")
    return T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.LongType()), T.StructField("doc_id", id_type), *rest])


def build(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes path/recipes (n, doc_id, n_tokens, digest, recipe, root) and path/chunks (name, payload)."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def chunk(batches):
        encoder, seen = Encoder.get(vocabulary), set()
        kind = np.uint16 if encoder.enc.max_token_value < 1 << 16 else np.uint32
        for b in batches:
            n, step = b.column(0), K.SLICE
            for a, texts in K.slices(b.column(2), lower=False):
                size, recipe, root, names, payloads = [], [], [], [], []
                streams = encoder.encode(texts)
                sums = digests(np.concatenate([np.zeros(0, np.uint32), *streams]), np.cumsum([len(x) for x in streams], dtype=np.int64)).tolist()
                for t, ids in zip(texts, streams):
                    raw, last, mine = ids.astype(kind).tobytes(), 0, []
                    width = kind().itemsize
                    for c in cuts(ids):
                        p = raw[last * width : c * width]
                        last = c
                        x = name_of(p)
                        mine.append(x)
                        if x not in seen:
                            seen.add(x)
                            names.append(x)
                            payloads.append(p)
                    size.append(None if t is None else len(ids))
                    recipe.append(mine)
                    root.append(merkle_root(mine))
                d, c = len(size), len(names)
                column = lambda docs_, chunks, t: pa.array([*docs_, *chunks], t)
                given = lambda x: pa.concat_arrays([x.slice(a, step), pa.nulls(c, x.type)])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        column(["recipes"] * d, ["chunks"] * c, pa.string()), given(n), given(b.column(1)), column(size, [None] * c, pa.int64()), column(sums, [None] * c, pa.list_(pa.int64())),
                        column(recipe, [None] * c, pa.list_(pa.binary())), column(root, [None] * c, pa.binary()), column([None] * d, names, pa.binary()), column([None] * d, payloads, pa.binary()),
                    ],
                    names=["kind", "n", "doc_id", "n_tokens", "digest", "recipe", "root", "name", "payload"],
                )

    staged = f"{path}/staged"
    schema = _schema(rows.schema["doc_id"].dataType)
    rows.mapInArrow(chunk, schema).write.partitionBy("kind").option("compression", "zstd").parquet(staged)
    every = spark.read.schema(schema).parquet(staged)
    # a chunk's place in the staged files, which are written once and don't change
    chunks = every.where("kind = 'chunks'").select("name", "payload", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("at"))
    again = chunks.groupBy("name").agg(F.count("*").alias("c"), F.min("at").alias("first")).where("c > 1").select("name", "first")
    first = small_or_shuffled(again)
    kept = chunks.join(first, "name", "left").where("first is null or first = at").select("name", "payload")
    kept.write.option("compression", "zstd").parquet(f"{path}/chunks")
    remove(spark, f"{staged}/kind=chunks")


def recipes(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """The recipes of a store whose doc_ids are of that type (long)."""
    return spark.read.schema(_schema(id_type or T.LongType())).parquet(f"{path}/staged").where("kind = 'recipes'").select("n", "doc_id", "n_tokens", "digest", "recipe", "root")


def verify(spark: SparkSession, path: str, vocabulary: str = VOCABULARY, id_type: T.DataType | None = None) -> DataFrame:
    """doc_id, n_tokens, n_chunks, recipe and merkle_root in hex, verified, of every document."""
    kind = np.uint16 if Encoder.get(vocabulary).enc.max_token_value < 1 << 16 else np.uint32

    def right(batches):
        for b in batches:
            for a in range(0, max(b.num_rows, 1), 4096):
                part = b.slice(a, 4096)
                names, payloads = part.column(0).to_pylist(), part.column(1).to_pylist()
                size = np.array([len(p) // kind().itemsize for p in payloads], np.int64)
                d = digests(np.frombuffer(b"".join(p[: len(p) // kind().itemsize * kind().itemsize] for p in payloads), kind), np.cumsum(size))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([name_of(p) == x for x, p in zip(names, payloads)], pa.bool_())], names=["name", "size", "d0", "d1", "ok"])

    def rooted(batches):
        for b in batches:
            ok = [merkle_root(r) == x for r, x in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=[*b.schema.names, "rooted"])

    def joined(batches):
        for b in batches:
            lists = b.column(1)
            size, *d = (lists.flatten().field(k).to_numpy() for k in ("size", "d0", "d1"))
            found = joined_digests(size, np.stack(d, 1), np.cumsum(np.diff(lists.offsets.to_numpy())).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(found.tolist(), pa.list_(pa.int64()))], names=["n", "there", "size", "joined"])

    docs = recipes(spark, path, id_type)
    store = spark.read.parquet(f"{path}/chunks").mapInArrow(right, "name binary, size long, d0 long, d1 long, ok boolean")
    parts = docs.select("n", F.posexplode("recipe").alias("pos", "name")).join(store, "name", "left")
    lists = parts.groupBy("n").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("pos", "size", "d0", "d1")))).alias("p"), F.every(F.coalesce("ok", F.lit(False))).alias("there"), F.sum("size").alias("size"))
    whole = lists.mapInArrow(joined, "n long, there boolean, size long, joined array<long>").withColumnRenamed("n", "_n")
    rows = docs.mapInArrow(rooted, T.StructType([*docs.schema, T.StructField("rooted", T.BooleanType())])).join(whole, F.col("n") == F.col("_n"), "left")
    empty = (F.size("recipe") == 0) & (F.coalesce("n_tokens", F.lit(0)) == 0)
    good = F.col("rooted") & F.coalesce(F.col("there") & (F.col("size") == F.col("n_tokens")) & (F.col("joined") == F.col("digest")), empty)
    return rows.select("doc_id", "n_tokens", F.size("recipe").alias("n_chunks"), F.transform("recipe", F.hex).alias("recipe"), F.hex("root").alias("merkle_root"), good.alias("verified"))


def read_documents(spark: SparkSession, path: str, vocabulary: str = VOCABULARY, id_type: T.DataType | None = None) -> DataFrame:
    """n, doc_id, ids: the token ids put together again from the chunks."""
    kind = np.uint16 if Encoder.get(vocabulary).enc.max_token_value < 1 << 16 else np.uint32
    docs = recipes(spark, path, id_type)
    parts = docs.select("n", "doc_id", F.posexplode_outer("recipe").alias("pos", "name")).join(spark.read.parquet(f"{path}/chunks"), "name", "left")
    lists = parts.groupBy("n", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("p"))

    def join(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(x["payload"] or b"" for x in p), kind).astype(np.int32) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["n", "doc_id", "ids"])

    return lists.mapInArrow(join, T.StructType([*lists.schema.fields[:2], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def store_documents(docs: DataFrame) -> DataFrame:
    """Builds a store in the shared folder and verifies it."""
    path = new_path(docs.sparkSession, "token-store")
    build(docs, path)
    return verify(docs.sparkSession, path, id_type=docs.schema["doc_id"].dataType)
