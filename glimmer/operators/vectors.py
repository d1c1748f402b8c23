"""Vectors: similarity, nearest neighbours, novelty, drift, areas, and greedy selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glimmer.operators.graph import connected_components

#: Rows of one side that meet a block of the other in one product.
BLOCK = 2048
#: Blocks of a side in a cell of the grid.
CELL = 8


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            vectors = np.array(part.column("vec").to_pylist(), np.float64)
            vectors = np.nan_to_num(vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) if len(vectors) else vectors
            ids = np.asarray(part.column("id").to_numpy(zero_copy_only=False), np.int64)
            yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "vecs": [vectors.tobytes()], "n": [len(ids)]})


def _blocks(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(_packed, "ids binary, vecs binary, n long")


def _compared(k: int | None, least: float | None, ordered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["b_ids"], np.int64)
                s = np.frombuffer(row["vecs"]).reshape(len(a), -1) @ np.frombuffer(row["b_vecs"]).reshape(len(b), -1).T
                keep = a[:, None] < b[None, :] if ordered else a[:, None] != b[None, :]
                if least is not None:
                    keep &= s >= least
                if k is not None and len(b) > k:
                    s = np.where(keep, s, -np.inf)
                    keep &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_pydict({"a": a[i], "b": b[j], "similarity": s[i, j]})

    return run


def compare(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, k: int | None = None, least: float | None = None, ordered: bool = False) -> DataFrame:
    """(a, b, similarity): cosine of rows of left with rows of right, blocked matrix products.

    Blocks of BLOCK rows meet through a grid of cells that grows with both sides, so that a cell holds CELL blocks of each
    whatever the input; only what passes leaves a block. With k, each block leaves its k best per row (and ties); the
    caller ranks them.
    """
    x, y = _blocks(left, id_col, vec_col), _blocks(right, id_col, vec_col).select(F.col("ids").alias("b_ids"), F.col("vecs").alias("b_vecs"))
    m, n = (max(8, -(-df.count() // (BLOCK * CELL))) for df in (left, right))
    spread = lambda df, at, over, own, other: df.withColumn(at, F.pmod(F.xxhash64(df.columns[0]), F.lit(own)).cast("int")).withColumn(over, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    met = spread(x, "i", "j", m, n).join(spread(y, "j", "i", n, m), ["i", "j"])
    return met.select("ids", "vecs", "b_ids", "b_vecs").mapInArrow(_compared(k, least, ordered), "a long, b long, similarity double")


def nearest(left: DataFrame, right: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, rank, b, similarity): the k most similar rows of right for each row of left, itself excluded, ties by id."""
    best = compare(left, right, id_col, vec_col, k=k)
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc(F.round("similarity", 9)), "b"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "rank", "b", "similarity")


def similar_pairs(rows: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, similarity): pairs a < b at least that similar."""
    return compare(rows, rows, id_col, vec_col, least=least, ordered=True)


def novelty(recent: DataFrame, prior: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, novelty): 1 minus the greatest similarity to any prior row."""
    return compare(recent, prior, id_col, vec_col, k=1).groupBy(F.col("a").alias("id")).agg((1 - F.max("similarity")).alias("novelty"))


def precedents(rows: DataFrame, labels: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, precedent_gap, cross_domain): 1 minus mean similarity of k neighbours, and their share of other labels."""
    near = nearest(rows, rows, k, id_col, vec_col)
    own, other = labels.toDF("a", "la"), labels.toDF("b", "lb")
    return near.join(own, "a").join(other, "b").groupBy(F.col("a").alias("id")).agg((1 - F.avg("similarity")).alias("precedent_gap"), F.avg((F.col("la") != F.col("lb")).cast("double")).alias("cross_domain"))


def centroids(rows: DataFrame, by: list[str], vec_col: str = "embedding") -> DataFrame:
    """(by..., centroid, n): mean vectors, element by element."""
    place = rows.select(*by, F.posexplode(vec_col).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return place.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def drift(rows: DataFrame, topic: str, early: Column, least: int = 10, vec_col: str = "embedding") -> DataFrame:
    """(topic, drift): 1 minus the cosine of the early and the late centroid, where each has enough rows."""
    c = centroids(rows.withColumn("__early", early), [topic, "__early"], vec_col).where(F.col("n") >= least)
    x, y = c.where("__early").select(topic, F.col("centroid").alias("a")), c.where("NOT __early").select(topic, F.col("centroid").alias("b"))
    return x.join(y, topic).select(topic, (1 - cosine(F.col("a"), F.col("b"))).alias("drift"))


def area_vote(query: DataFrame, rows: DataFrame, areas: DataFrame, nearest_n: int = 100) -> DataFrame:
    """(query_id, area, vote): the areas of the nearest rows, similarity over the root of the area's size."""
    near = nearest(query, rows, nearest_n)
    size = areas.groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    return near.join(areas.select(F.col("vec_id").alias("b"), "area"), "b").join(size, "area").groupBy(F.col("a").alias("query_id"), "area").agg(F.sum(F.col("similarity") / F.sqrt("n")).alias("vote"))


def twins(rows: DataFrame, features: DataFrame, k: int = 50) -> DataFrame:
    """(id, twin, distance): of the k nearest by meaning the nearest by features (id, f array)."""
    near = nearest(rows, rows, k)
    x, y = features.toDF("a", "fa"), features.toDF("b", "fb")
    distance = F.sqrt(F.aggregate(F.zip_with("fa", "fb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return near.join(x, "a").join(y, "b").withColumn("d", F.round(distance, 9)).groupBy(F.col("a").alias("id")).agg(F.min_by("b", F.struct("d", "b")).alias("twin"), F.min("d").alias("distance"))


def similarity_components(rows: DataFrame, least: float) -> DataFrame:
    """(vec_id, component, size): components of rows linked by similarity; rows without a link are left out."""
    found = connected_components(similar_pairs(rows, least), "a", "b")
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return found.join(size, "component").select(F.col("node").alias("vec_id"), "component", "size")


def greedy_kept(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, kept): walking items (id, rank) by rank, one is kept unless it conflicts (a, b) with one kept before.

    In rounds, without a driver loop over rows: an item with no undecided better neighbour is decided at once. As many
    rounds as the longest chain of conflicts has links that depend on one another.
    """
    from glimmer.operators.graph import settled

    r = items.select("id", "rank")
    both = conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edge = settled(both.join(r.toDF("a", "ra"), "a").join(r.toDF("b", "rb"), "b").where("rb < ra OR (rb = ra AND b < a)").select("a", "b").distinct())
    state = settled(r.select("id", F.lit(None).cast("boolean").alias("kept")))
    while state.where("kept IS NULL").limit(1).count():
        seen = edge.join(state.toDF("b", "kb"), "b").groupBy("a").agg(F.max(F.coalesce("kb", F.lit(False))).alias("blocked"), F.max(F.col("kb").isNull()).alias("waiting")).withColumnRenamed("a", "id")
        now = state.join(seen, "id", "left")
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("blocked", F.lit(False)), F.lit(False)).when(~F.coalesce("waiting", F.lit(False)), F.lit(True))
        state = settled(now.select("id", new.alias("kept")))
    return state
