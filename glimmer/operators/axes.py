"""Explainable axes of a term: its parent, the stage of its curve, its way through the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glimmer.operators.rank import quantiles
from glimmer.operators.windows import Params


def parent(terms: DataFrame, p: Params) -> DataFrame:
    """(phrase, parent, parent_docs_log, incremental_lex) for terms (phrase, first_year, docs_now).

    A parent is a mature phrase that is the last word, the last two words, or all but the first or last word; the one
    with the most documents wins, then the first in that order.
    """
    w = F.split("phrase", " ")
    n = F.size(w)
    made = F.array_compact(F.array(F.when(n > 1, F.element_at(w, -1)), F.when(n > 2, F.array_join(F.slice(w, -2, 2), " ")), F.when(n > 1, F.array_join(F.slice(w, 2, F.greatest(n - 1, F.lit(1))), " ")), F.when(n > 1, F.array_join(F.slice(w, 1, F.greatest(n - 1, F.lit(1))), " "))))
    mature = terms.where((F.col("first_year") <= p.cutoff - p.parent_age) & (F.col("docs_now") >= p.parent_docs)).select(F.col("phrase").alias("parent"), F.col("docs_now").alias("parent_docs"))
    asked = terms.select("phrase", F.posexplode(F.array_distinct(made)).alias("at", "parent"))
    best = asked.join(mature, "parent").groupBy("phrase").agg(F.max_by(F.struct("parent", "parent_docs"), F.struct(F.col("parent_docs"), -F.col("at"))).alias("b"))
    return terms.join(best, "phrase", "left").select("phrase", F.col("b.parent").alias("parent"), F.log1p(F.col("b.parent_docs").cast("double")).alias("parent_docs_log"), F.log2((F.col("b.parent_docs") + 1) / (F.col("docs_now") + 1)).alias("incremental_lex"))


def share_series(cube: DataFrame, totals: DataFrame, first: int, cutoff: int) -> DataFrame:
    """(entity, year, docs, share) for every entity and year: years without documents are rows of zero."""
    yearly = totals.where(F.col("year").between(first, cutoff)).groupBy("year").agg(F.sum("n_docs").alias("n"))
    own = cube.where(F.col("year").between(first, cutoff)).groupBy("entity", "year").agg(F.sum("df").cast("long").alias("docs"))
    spine = cube.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(first), F.lit(cutoff))).alias("year"))
    dense = spine.join(own, ["entity", "year"], "left").join(yearly, "year", "left")
    return dense.select("entity", "year", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"), (F.coalesce("docs", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("share"))


def stage(series: DataFrame, p: Params) -> DataFrame:
    """(entity, accel, peak_ratio, recent_share) at the cutoff, from a dense share series."""
    by = W.partitionBy("entity").orderBy("year")
    s = F.col("share") + 1e-7
    rows = series.withColumns({"s1": F.lag(s, 1).over(by), "s2": F.lag(s, 2).over(by), "peak": F.max("share").over(by.rowsBetween(W.unboundedPreceding, -1)), "all": F.sum("docs").over(by), "now": F.sum("docs").over(by.rowsBetween(1 - p.recent_years, 0))})
    last = rows.where(F.col("year") == p.cutoff)
    return last.select("entity", (F.log2(s / F.col("s1")) - F.log2(F.col("s1") / F.col("s2"))).alias("accel"), F.when(F.col("peak") > 0, F.col("share") / F.col("peak")).alias("peak_ratio"), F.when(F.col("all") > 0, F.col("now") / F.col("all")).alias("recent_share"))


def layers(firsts: DataFrame, science: str = "science", community: str = "hn", market: tuple[str, ...] = ("yc", "press")) -> DataFrame:
    """(entity, layer_count, only_science, lag_community, lag_market) from (entity, layer, first).

    first is the first year (or day number) of a layer, already cut off by the caller.
    """
    at = lambda names: F.min(F.when(F.col("layer").isin(*names), F.col("first")))
    rows = firsts.groupBy("entity").agg(at([science]).alias("sci"), at([community]).alias("com"), at(list(market)).alias("mar"), F.count_if((F.col("layer") != science) & F.col("first").isNotNull()).alias("reached"))
    return rows.select("entity", (F.col("reached") + 1).cast("long").alias("layer_count"), (F.col("reached") == 0).alias("only_science"), (F.col("com") - F.col("sci")).cast("long").alias("lag_community"), (F.col("mar") - F.col("sci")).cast("long").alias("lag_market"))


def acceleration(series: DataFrame, late: tuple[int, int], early: tuple[int, int]) -> DataFrame:
    """(entity, acceleration): summed share late over early, smoothed by 1e-12."""
    total = lambda y: F.sum(F.when(F.col("year").between(*y), F.col("share")).otherwise(F.lit(0.0)))
    return series.groupBy("entity").agg(((total(late) + 1e-12) / (total(early) + 1e-12)).alias("acceleration"))


def doc_novelty(docs: DataFrame, orphan_at: float = 0.95) -> DataFrame:
    """(entity, novelty_mean, novelty_p90, orphan_share, n) from (entity, novelty); an orphan is at or above the
    corpus's own quantile."""
    edge = quantiles(docs, "novelty", [orphan_at]).select(F.col("q")[0].alias("edge"))
    return docs.join(F.broadcast(edge)).groupBy("entity").agg(F.avg("novelty").alias("novelty_mean"), F.percentile("novelty", 0.9).alias("novelty_p90"), F.avg((F.col("novelty") >= F.col("edge")).cast("double")).alias("orphan_share"), F.count(F.lit(1)).alias("n"))
