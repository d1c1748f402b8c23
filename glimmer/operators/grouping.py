"""Selections that walk items by rank: leaders with what belongs to them, a second list, names inside names, merged cards.

All of them are greedy choices over a table of conflicts (a, b); vectors.greedy_kept makes the choice in rounds, so that no
step looks at all pairs or at one row after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.operators.pairs import set_overlap
from glimmer.operators.vectors import greedy_kept


def both_ways(conflicts: DataFrame) -> DataFrame:
    return conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def grouped(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, leader): walking items (id, rank), one that conflicts with an earlier leader belongs to the first such leader,
    and leads otherwise. Only leaders are compared with."""
    kept = greedy_kept(items, conflicts)
    leaders = kept.where("kept").select("id").join(items.select("id", "rank"), "id").select(F.col("id").alias("b"), "rank")
    first = both_ways(conflicts).join(leaders, "b").groupBy(F.col("a").alias("id")).agg(F.min(F.struct("rank", "b")).getField("b").alias("found"))
    return kept.join(first, "id", "left").select("id", F.when(F.col("kept"), F.col("id")).otherwise(F.col("found")).alias("leader"))


def extra_list(items: DataFrame, shown: DataFrame, conflicts: DataFrame, k: int = 60) -> DataFrame:
    """(id, place): the first k items by rank that conflict neither with what is shown (id) nor with one another."""
    near = both_ways(conflicts).join(shown.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).unionByName(shown.select("id")).distinct()
    free = items.join(near, "id", "left_anti")
    kept = greedy_kept(free, conflicts.join(free.select(F.col("id").alias("a")), "a", "left_semi").join(free.select(F.col("id").alias("b")), "b", "left_semi"))
    first = free.join(kept.where("kept").select("id"), "id", "left_semi").orderBy("rank", "id").limit(k)
    # At most k rows from here on.
    return first.agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r")).select(F.posexplode("r").alias("p", "x")).select("x.id", (F.col("p") + 1).alias("place"))


def contained(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(a, b): phrases whose normal form (hyphens as spaces) stands inside another's, as characters.

    Every phrase lists the parts of its normal form that are as long as some phrase, and meets them by an equi-join.
    """
    norm = F.replace(F.col(phrase), F.lit("-"), F.lit(" "))
    own = phrases.select(F.col(phrase).alias("id"), norm.alias("n")).distinct()
    # One row: the distinct lengths of phrases, few by nature.
    lengths = own.agg(F.array_sort(F.collect_set(F.length("n"))).alias("sizes"))
    parts = F.flatten(F.transform(F.filter("sizes", lambda k: k <= F.length("n")), lambda k: F.transform(F.sequence(F.lit(1), F.length("n") - k + 1), lambda i: F.substr("n", i, k))))
    whole = own.join(F.broadcast(lengths)).select(F.col("id").alias("b"), F.explode(F.array_distinct(parts)).alias("n"))
    return whole.join(own.select(F.col("id").alias("a"), "n"), "n").where("a <> b").select("a", "b")


def merged_cards(candidates: DataFrame, members: DataFrame, least_docs: int = 8, overlap: float = 0.5, bonus: float = 0.5) -> DataFrame:
    """(card, n_evidence, layers, score, n_docs): candidates (card, layer, rank) whose documents (card, doc_id) overlap those of
    a better one by half of the smaller set are its evidence; a card's score is the sum of the best ranks of its layers
    and a bonus for each layer beyond the first. Better is a greater rank, then the name."""
    size = members.groupBy("card").agg(F.countDistinct("doc_id").alias("n"))
    own = candidates.join(size.where(F.col("n") >= least_docs).select("card"), "card", "left_semi")
    conflicts = set_overlap(members.join(own.select("card"), "card", "left_semi"), overlap)
    led = grouped(own.select(F.col("card").alias("id"), (-F.col("rank")).alias("rank")), conflicts).withColumnRenamed("id", "card")
    rows = own.join(led, "card")
    layers = rows.groupBy("leader", "layer").agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("k"))
    cards = layers.groupBy("leader").agg(F.sum("k").alias("n_evidence"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"), (F.sum("best") + bonus * (F.count(F.lit(1)) - 1)).alias("score"))
    docs = members.join(led, "card").groupBy("leader").agg(F.countDistinct("doc_id").alias("n_docs"))
    return cards.join(docs, "leader").withColumnRenamed("leader", "card")


def verdicts_by(verdicts: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """(by..., lists, precision, on_topic, i, m, x) of verdicts (query, place, verdict) in the first k places: shares to three
    places of S; of S, I and M; and of each of the others."""
    top = verdicts.where(F.col("place") < k)
    share = lambda *v: F.round(F.avg(F.col("verdict").isin(*v).cast("double")), 3)
    return top.groupBy(*by).agg(F.countDistinct("query").alias("lists"), share("S").alias("precision"), share("S", "I", "M").alias("on_topic"), share("I").alias("i"), share("M").alias("m"), share("X").alias("x"))
