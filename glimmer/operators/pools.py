"""Pools of a topic: the candidates nearest to each area, and the first of them by several orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators import rank as R

#: Columns of a result.
SHOWN = ("area", "method", "pos", "key", "relevance", "learned", "pool_pct")


def _first(pool: DataFrame, methods: dict[str, str], shown: int) -> DataFrame:
    """The first of each area by each method (name: column), ties by key."""
    parts = [R.top_per(pool, ["area"], [F.desc(F.round(by, 9)), F.asc("key")], shown, "pos").withColumn("method", F.lit(m)) for m, by in methods.items()]
    return reduce(DataFrame.unionByName, parts)


def _pool(rows: DataFrame, by: str, size: int) -> DataFrame:
    """Each area's first rows by a column, as many as size says, with percentiles within that pool."""
    pool = R.top_per(rows, ["area"], [F.desc(F.round(by, 9)), F.asc("key")], size, "__pos").drop("__pos")
    # A window over a pool's size of rows.
    return pool.withColumns({"pool_pct": R.percentile_rank("learned", ("area",)), "rel_pct": R.percentile_rank("relevance", ("area",))}).withColumn("blend", F.col("pool_pct") * F.col("rel_pct"))


def topic_orders(rows: DataFrame, pool: int = 500, shown: int = 15) -> DataFrame:
    """SHOWN and hand: each area's pool by the mean percentile of meaning and of the area's share, in four orders: relevance,
    hand, learned, and the product of the percentiles of learned and relevance within the pool.

    rows: (area, key, semantic, share, learned, hand); percentiles are among all candidates of the area.
    """
    ranked = R.percentile_ranked(R.percentile_ranked(rows, "semantic", "__s", by=("area",)), "share", "__a", by=("area",))
    near = ranked.withColumn("relevance", 0.5 * F.col("__s") + 0.5 * F.col("__a")).drop("__s", "__a")
    return _first(_pool(near, "relevance", pool), {m: m for m in ("relevance", "hand", "learned", "blend")}, shown).select(*SHOWN, "hand")


def tagged_orders(rows: DataFrame, topic: int = 300, shown: int = 15, least: float = 0.30) -> DataFrame:
    """SHOWN in five orders: of the topic's nearest by relevance, learned, their blend, and learned among those tagged with the
    area; and learned among the best by the mean percentile of relevance and share, of those that are tagged or have
    the share. rows: (area, key, relevance, share, learned, tagged)."""
    near = _pool(rows, "relevance", topic)
    ranked = R.percentile_ranked(R.percentile_ranked(rows, "relevance", "__r", by=("area",)), "share", "__s", by=("area",))
    own = (F.coalesce("share", F.lit(0.0)) >= least) | F.coalesce("tagged", F.lit(False))
    mixed = _pool(ranked.withColumn("mix", 0.5 * F.col("__r") + 0.5 * F.col("__s")).drop("__r", "__s").where(own), "mix", topic)
    parts = (_first(near, {"relevance": "relevance", "learned": "learned", "blend": "blend"}, shown), _first(near.where("tagged"), {"tag": "learned"}, shown), _first(mixed, {"mix": "learned"}, shown))
    return reduce(DataFrame.unionByName, (p.select(*SHOWN) for p in parts))
