"""Growth, rate, novelty, spread, fragments, and the candidate rule. NULL means not measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.operators.windows import Params


def during(value: Column | str, years: tuple[int, int], year: str = "year") -> Column:
    """Sum of a value over an inclusive range of years, 0 if there is none."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(F.col(year).between(*years), value)), F.lit(0))


def window_sums(cube: DataFrame, totals: DataFrame, p: Params) -> DataFrame:
    """(entity, source, d_recent, d_base, n_recent, n_base)."""
    own = cube.groupBy("entity", "source").agg(during("df", p.recent).cast("long").alias("d_recent"), during("df", p.base).cast("long").alias("d_base"))
    every = totals.groupBy("source").agg(during("n_docs", p.recent).cast("long").alias("n_recent"), during("n_docs", p.base).cast("long").alias("n_base"))
    return own.join(every, "source").select("entity", "source", "d_recent", "d_base", "n_recent", "n_base")


def growth(sums: DataFrame) -> DataFrame:
    """(entity, growth): log2 of smoothed rates, averaged over the sources in which it is measured."""
    ratio = ((F.col("d_recent") + 1) / F.col("n_recent")) / ((F.col("d_base") + 1) / F.col("n_base"))
    own = F.when((F.col("d_recent") + F.col("d_base") >= 3) & (F.col("n_recent") > 0) & (F.col("n_base") > 0), F.log2(ratio))
    return sums.groupBy("entity").agg(F.avg(own).alias("growth"))


def volumes(sums: DataFrame) -> DataFrame:
    """(entity, volume, max_rate, n_sources) in the recent window."""
    rate = F.when(F.col("n_recent") > 0, F.col("d_recent") / F.col("n_recent")).otherwise(F.lit(0.0))
    return sums.groupBy("entity").agg(F.sum("d_recent").cast("long").alias("volume"), F.max(rate).alias("max_rate"), F.count_if(F.col("d_recent") > 0).alias("n_sources"))


def first_year(cube: DataFrame, least: int, cutoff: int) -> DataFrame:
    """(entity, first_year): the first year up to the cutoff with that many documents over all sources; 0 if none."""
    yearly = cube.where(F.col("year") <= cutoff).groupBy("entity", "year").agg(F.sum("df").alias("df"))
    return yearly.groupBy("entity").agg(F.coalesce(F.min(F.when(F.col("df") >= least, F.col("year"))), F.lit(0)).cast("int").alias("first_year"))


def spread(groups: DataFrame, sizes: DataFrame, min_group: int, min_docs: int) -> DataFrame:
    """(entity, spread): normalised entropy of rates over groups that are large enough; NULL below min_docs.

    groups: (entity, grp, df); sizes: (grp, n_docs).
    """
    large = sizes.where(F.col("n_docs") >= min_group)
    n = large.agg(F.count(F.lit(1)).alias("n_groups"))
    rates = groups.join(large, "grp").select("entity", "df", (F.col("df") / F.col("n_docs")).alias("rate"))
    # With r = sum of rates: -sum(p ln p) = ln r - sum(rate ln rate) / r, in one aggregation.
    sums = rates.groupBy("entity").agg(F.sum("rate").alias("r"), F.sum(F.when(F.col("rate") > 0, F.col("rate") * F.ln("rate"))).alias("s"), F.sum("df").alias("d"))
    # The number of groups is one row by construction.
    joined = sums.join(F.broadcast(n))
    entropy = (F.ln("r") - F.col("s") / F.col("r")) / F.nullif(F.ln("n_groups"), F.lit(0.0))
    return joined.select("entity", F.when(F.col("d") >= min_docs, entropy).alias("spread"))


def super_share(phrases: DataFrame) -> DataFrame:
    """(phrase, super_share): the largest volume of a phrase that holds it, over its own. phrases: (phrase, volume).

    Every phrase lists its contiguous proper parts and meets them by an equi-join, never by LIKE.
    """
    w = F.split("phrase", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))))
    parts = F.filter(parts, lambda x: x != F.col("phrase"))
    above = phrases.select(F.explode(F.array_distinct(parts)).alias("phrase"), F.col("volume").alias("v")).groupBy("phrase").agg(F.max("v").alias("best"))
    return phrases.join(above, "phrase", "left").select("phrase", "volume", F.when(F.col("volume") > 0, F.coalesce(F.col("best"), F.lit(0)) / F.col("volume")).otherwise(F.lit(0.0)).alias("super_share"))


def is_candidate(p: Params) -> Column:
    """Volume, growth or novelty, rate, spread, generic, fragment, sources; an unknown spread passes."""
    return (
        (F.col("volume") >= p.min_volume)
        & (F.coalesce(F.col("growth") >= p.min_growth, F.lit(False)) | (F.col("first_year") >= p.new_since))
        & (F.col("max_rate") <= p.max_rate)
        & (F.col("spread").isNull() | (F.col("spread") <= p.max_spread))
        & ~F.col("generic")
        & (F.col("super_share") < p.fragment_share)
        & (F.col("n_sources") >= p.min_sources)
    )


def hand_score(p: Params) -> Column:
    """Growth, novelty and sources against spread and volume beyond a weak signal's."""
    grown = F.least(F.greatest(F.coalesce("growth", F.lit(0.0)), F.lit(0.0)), F.lit(6.0))
    sources = F.least(F.greatest(F.col("n_sources") - 1, F.lit(0)), F.lit(2))
    return grown + (F.col("first_year") >= p.new_since).cast("double") + 0.5 * sources - F.coalesce("spread", F.lit(0.5)) - 0.5 * F.log10(F.greatest(F.col("volume") / p.weak_volume, F.lit(1.0)))


def scored(cube: DataFrame, totals: DataFrame, groups: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """All measures of every entity, with generic and super_share left at false and 0 for entities that aren't phrases."""
    sums = window_sums(cube, totals, p)
    out = volumes(sums).join(growth(sums), "entity").join(first_year(cube, 2, p.cutoff), "entity").join(spread(groups, sizes, p.min_group_docs, p.min_spread_docs), "entity", "left")
    out = out.withColumns({"generic": F.lit(False), "super_share": F.lit(0.0)})
    return out.withColumn("candidate", is_candidate(p)).withColumn("score", hand_score(p))


def business_scored(rows: DataFrame, min_volume: int, min_growth: float, new_since: int, max_rate: float, fragment_share: float = 0.8) -> DataFrame:
    """Adds volume, candidate, layers and score to terms seen by communities, startups and press.

    rows: (hn_recent, hn_base, yc_recent, press_recent, launches, hn_rate, growth, first_year, sci_recent, generic, super_share).
    """
    volume = F.col("hn_recent") + F.col("yc_recent") + F.col("press_recent")
    fresh = F.col("first_year") >= new_since
    candidate = (volume >= min_volume) & (F.coalesce(F.col("growth") >= min_growth, F.lit(False)) | fresh | (F.col("yc_recent") >= 2)) & (F.col("hn_rate") <= max_rate) & ~F.col("generic") & (F.col("super_share") < fragment_share)
    there = lambda c: (F.coalesce(F.col(c), F.lit(0)) > 0).cast("int")
    layers = there("sci_recent") + there("hn_recent") + there("yc_recent") + there("press_recent")
    grown = F.least(F.greatest(F.coalesce("growth", F.lit(0.0)), F.lit(0.0)), F.lit(6.0))
    beyond = F.least(F.greatest(layers - 1, F.lit(0)), F.lit(3))
    score = grown + fresh.cast("double") + 0.7 * F.log1p("yc_recent") + 0.3 * F.log1p("launches") + 0.5 * beyond - 0.5 * F.log10(F.greatest(volume / 200, F.lit(1.0)))
    return rows.withColumns({"volume": volume.cast("long"), "candidate": candidate, "layers": layers, "score": score})
