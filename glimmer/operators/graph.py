"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two partial aggregations and two equi-joins, so a hub's edges are never collected
into one task: its minimum is pre-aggregated before the shuffle and its edges are joined with one
row, in a shuffle of their own that adaptive execution may split. Rounds are cut with checkpoint()
into the session's shared folder; their number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one (tests) gets a temporary one: on a
    cluster executors would not see it."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="glimmer-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared checkpoint folder, so that later steps neither
    recompute them nor depend on an executor that may be lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges are (low, high), distinct, low < high."""
    both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # The second key gives the join a shuffle of its own: one that an aggregation shares can't be split at a hub.
    keyed = lambda df: df.withColumn("h", F.xxhash64("u"))
    large = keyed(both.where("v > u")).join(keyed(least), ["u", "h"]).select(F.col("m").alias("low"), F.col("v").alias("high")).where("low < high").distinct()
    smallest = large.groupBy("high").agg(F.min("low").alias("m"))
    linked = large.join(smallest, "high").select(F.explode(F.array(F.struct(F.col("m").alias("low"), F.col("low").alias("high")), F.struct(F.col("m").alias("low"), F.col("high").alias("high")))).alias("e"))
    return linked.select("e.low", "e.high").where("low < high").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the smallest node.

    Null ends and self-loops are ignored, repeated edges count once. Nodes must be orderable.
    """
    state = settled(edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.col(a).isNotNull().alias("p"), F.col(b).isNotNull().alias("q")).where("p AND q AND low < high").select("low", "high").distinct())
    mark = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("s")
    seen = state.agg(*mark).first()
    while seen[0]:
        state = settled(_round(state))
        now = state.agg(*mark).first()
        if now == seen:
            break
        seen = now
    return state.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(state.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
