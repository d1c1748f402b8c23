"""Operator 4, exact top-k search: tiled integer matrix products.

Vectors are packed into shards and queries into blocks of a fixed number of rows. A cell of a grid brings every
block together with every shard once; each such tile is one matrix product, of which each query keeps its
k best; the lists are merged by a tree of bounded fan-in. No task holds more than a shard, a block and their
product.

Components are floor(256 * x). Products are exact: in float32 or float64 where the greatest possible sum fits
their mantissa, else in Python's integers, and a score beyond 64 bits is brought back to the nearest long.

Defined results: vectors that are null or hold a null or non-finite component take no part; vectors of different
lengths don't meet; a row is never a candidate for its own id; rows that share an id are candidates each, and
queries that share an id have one list, of the best over all of them; ties go to the smaller id; a null id takes
no part; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm import shared

SHARD_ROWS, BLOCK_ROWS, FAN_IN, SCALE = 4096, 1024, 16, 256


def _quantised(batch: pa.RecordBatch):
    """(dimension, ids, integers as float64) of each length of vector in a batch."""
    vectors = batch.column("vec")
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ids = np.asarray(batch.column("id").to_numpy(zero_copy_only=False), np.int64)
    sizes = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        values = np.floor(values * SCALE)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), ids[at], values[(first[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)


def _packed(rows: int):
    """Rows of at most so many vectors of one length, ordered by id: (part, dim, n, peak, ids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def out(d: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            part = int(shared.mixed(np.array([ids[0], ids[-1], len(ids)], np.int64).view(np.uint64)).sum() >> np.uint64(1))
            peak = float(np.abs(values).max(initial=0))
            return pa.RecordBatch.from_pydict({"part": [part], "dim": [d], "n": [len(ids)], "peak": [peak], "ids": [ids.tobytes()], "vectors": [values.astype(np.float32 if peak <= 1 << 24 else np.float64).tobytes()]}, pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("peak", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())]))

        for batch in batches:
            for d, ids, values in _quantised(batch):
                kept = waiting.setdefault(d, [])
                kept.append((ids, values))
                if sum(len(x) for x, _ in kept) >= rows:
                    ids, values = (np.concatenate(x) for x in zip(*kept))
                    whole = len(ids) // rows * rows
                    for a in range(0, whole, rows):
                        yield out(d, ids[a : a + rows], values[a : a + rows])
                    waiting[d] = [(ids[whole:], values[whole:])] if whole < len(ids) else []
        for d, kept in waiting.items():
            if kept:
                yield out(d, *(np.concatenate(x) for x in zip(*kept)))

    return run


def _read(n: int, dim: int, peak: float, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float32 if peak <= 1 << 24 else np.float64).reshape(n, dim)


def _product(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products as int64."""
    if bound < 1 << 24:
        return (a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best_of_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bound: float):
    """(row of the query, id, score): the k best of each query in a tile; ids must ascend."""
    scores = _product(queries, vectors, bound)
    own = query_ids[:, None] == ids[None, :]
    n = len(ids)
    if bound < (1 << 53) and bound * n < 1 << 61:  # one key for score and place, so no tie is left
        keys = scores * n + (n - 1 - np.arange(n))
        keys[own] = np.iinfo(np.int64).min
        top = np.argpartition(~keys, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(queries), 1))
    else:
        order = np.argsort(np.where(own, np.iinfo(np.int64).max, ~scores), axis=1, kind="stable")
        top = order[:, : k + int(own.sum(axis=1).max(initial=0))]
    row = np.repeat(np.arange(len(queries)), top.shape[1])
    at = top.ravel()
    fine = ~own[row, at]
    row, at = row[fine], at[fine]
    return row, ids[at], scores[row, at]


def _tiles(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("branch", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                query_ids, queries = _read(q["q_n"], q["dim"], q["q_peak"], q["q_ids"], q["q_vectors"])
                ids, vectors = _read(q["n"], q["dim"], q["peak"], q["ids"], q["vectors"])
                for a in range(0, len(query_ids), 256):
                    row, found, score = best_of_tile(query_ids[a : a + 256], queries[a : a + 256], ids, vectors, k, q["q_peak"] * q["peak"] * max(1, q["dim"]))
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[a : a + 256][row]), pa.array(np.full(len(row), q["part"])), pa.array(found), pa.array(score)], schema=schema)

    return run


def _merged(lists: DataFrame, k: int, keys: list) -> DataFrame:
    """The k best of each group of lists."""
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    return lists.groupBy(*keys).agg(best.alias("best"))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each query, by integer inner product."""
    vec = F.col(vector_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite)
    packed = "part bigint, dim int, n int, peak double, ids binary, vectors binary"
    shards = shared.settled(rows.select("id", "vec").mapInArrow(_packed(shard_rows), packed))
    asked = rows.where("q").select("id", "vec")
    blocks = shared.settled(asked.repartition(max(1, -(-asked.count() // block_rows))).mapInArrow(_packed(block_rows), packed))
    # A grid of about one cell for every 64 tiles: a shard goes to its row's cells, a block to its column's.
    tall, wide = max(1, -(-shards.count() // 8)), max(1, -(-blocks.count() // 8))
    across = shards.withColumn("down", F.pmod(F.xxhash64("part"), F.lit(tall))).withColumn("over", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))))
    along = blocks.select(*[F.col(c).alias(f"q_{c}") for c in ("part", "n", "peak", "ids", "vectors")], "dim").withColumn("over", F.pmod(F.xxhash64("q_part"), F.lit(wide))).withColumn("down", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tall - 1).cast("long"))))
    met = across.join(along, ["down", "over", "dim"])
    best = met.select("part", "dim", "n", "peak", "ids", "vectors", "q_n", "q_peak", "q_ids", "q_vectors").mapInArrow(_tiles(k), "query_id bigint, branch bigint, vec_id bigint, score bigint")
    # ~score ascends as the score descends and has no overflow.
    lists = best.groupBy("query_id", "branch").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("low"), "vec_id"))), 1, k).alias("best"))
    width = tall * 8
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        lists = _merged(lists.withColumn("branch", F.pmod(F.xxhash64("branch"), F.lit(width))), k, ["query_id", "branch"])
    lists = _merged(lists, k, ["query_id"])
    return lists.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.bitwise_not("b.low").alias("score"))
