"""The answer to a query: percentile ranks, weakness, exclusions, quotas, diversity, and evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glimmer.functions import text as X

#: Weights and penalties of the weakness score.
W_EXPERT, W_HISTORY, INC_MAX, INC_PENALTY, GENERAL_PENALTY, MATURE_YEAR = 0.7, 0.3, 3.0, 0.15, 0.35, 2019


def percentile_rank(value: str, by: tuple[str, ...] = ()) -> Column:
    """Average rank over count: ties share the mean of their places; NULL stays out."""
    part = W.partitionBy(*by, F.col(value).isNull()) if by else W.partitionBy(F.col(value).isNull())
    peers = W.partitionBy(*by, value) if by else W.partitionBy(value)
    return F.when(F.col(value).isNotNull(), (F.rank().over(part.orderBy(value)) + (F.count(F.lit(1)).over(peers) - 1) / 2) / F.count(F.lit(1)).over(part))


def cumulated(seen: DataFrame, value: str, weight: str, buckets: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, weight, __before, __all): the weight of smaller values and of all, without a window over the whole table.

    Distinct values are cut into buckets at approximate quantiles, summed up within their bucket, and moved by the exact
    sums of the buckets below: a value that a third of all rows share is one row, and no task sees all. by: columns
    of few values, not null, each of which is a table of its own.
    """
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = F.broadcast(seen.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), points, F.lit(10_000)).alias("__edges")))
    dealt = (seen.join(edges, list(by)) if by else seen.join(edges)).withColumn("__b", F.size(F.filter("__edges", lambda e: e < F.col(value).cast("double")))).drop("__edges")
    sizes = dealt.groupBy(*by, "__b").agg(F.sum(weight).alias("__k"))
    # At most `buckets` rows each.
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    below = sizes.select(*by, "__b", F.coalesce(F.sum("__k").over(whole.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__below"), F.sum("__k").over(whole).alias("__all"))
    inside = F.coalesce(F.sum(weight).over(W.partitionBy(*by, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__inside", inside).join(F.broadcast(below), [*by, "__b"]).select(*by, value, weight, (F.col("__below") + F.col("__inside")).alias("__before"), "__all")


def percentile_ranked(rows: DataFrame, value: str, name: str = "pct", buckets: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with percentile_rank of a whole table, or of each value of by."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = cumulated(seen, value, "__n", buckets, by).select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col(value).alias("__v"), ((F.col("__before") + (F.col("__n") + 1) / 2) / F.col("__all")).alias(name))
    same = [F.col(c) == F.col(f"__by_{c}") for c in by]
    return rows.join(ranked, [*same, F.col(value) == F.col("__v")], "left").drop("__v", *[f"__by_{c}" for c in by])


def quantiles(rows: DataFrame, value: str, points: list[float], buckets: int = 256) -> DataFrame:
    """One row (q): the exact quantiles, interpolated between neighbours, of a whole table."""
    seen = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v")).groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
    at = F.array(*[F.lit(float(p)) for p in points])
    asked = cumulated(seen, "__v", "__n", buckets).withColumn("__at", F.explode(F.transform(at, lambda p, i: F.struct(i.alias("i"), p.alias("p")))))
    place = F.col("__at.p") * (F.col("__all") - 1)
    holds = lambda k: (F.col("__before") <= k) & (k < F.col("__before") + F.col("__n"))
    # Two rows for each quantile are left at most.
    near = asked.where(holds(F.floor(place)) | holds(F.ceil(place)))
    part = near.groupBy(F.col("__at.i").alias("i")).agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.max(place - F.floor(place)).alias("f"))
    value_at = F.col("low") + (F.col("high") - F.col("low")) * F.col("f")
    return part.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value_at.alias("x")))), lambda r: r["x"]).alias("q"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in a whole order: a distributed sort, and the sizes of its partitions."""
    from glimmer.operators.graph import settled

    done = settled(rows.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    # One row for each partition of the sort.
    sizes = done.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__k"))
    return done.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, (F.col("__k") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("__part", "__place", "__k")


def weakness() -> Column:
    """0 to 1 from expert_p_axes, history_p_axes, expert, incremental_lex, kind, verdict."""
    e, h = F.col("expert_p_axes"), F.col("history_p_axes")
    base = F.when(e.isNotNull() & h.isNotNull(), W_EXPERT * e + W_HISTORY * h).when(e.isNotNull(), e).otherwise(F.col("expert"))
    improved = F.coalesce(F.col("incremental_lex") >= INC_MAX, F.lit(False)) | F.coalesce(F.col("kind") == "composite", F.lit(False))
    out = base - F.when(improved, INC_PENALTY).otherwise(0.0) - F.when(F.coalesce(F.col("verdict") == "G", F.lit(False)), GENERAL_PENALTY).otherwise(0.0)
    return F.coalesce(F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def exclusion() -> Column:
    """The code for which a row (phrase, kind, first_year, verdict) is left out, or NULL."""
    return F.when(X.is_standard(F.col("phrase"), F.col("kind")), "standard").when(F.col("first_year") <= MATURE_YEAR, "mature").when(F.col("verdict") == "M", "mature_review")


def axes_view(rows: DataFrame) -> DataFrame:
    """Axes as 0 to 1 bars, rounded half up; what wasn't measured stays NULL."""
    clip = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return rows.withColumns({"incremental": F.round(clip(F.col("incremental_lex") / 6), 3), "stage_early": F.round(1 / (1 + F.exp(-F.col("stage_accel"))), 3), "layer_early": F.col("layer_only_science").cast("double"), "novelty": F.round(clip(F.col("doc_novelty_mean") / 0.5), 3)})


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear interpolation, constant beyond the ends."""
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for a, b, p, q in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(x <= b, F.lit(float(p)) + (x - a) * ((q - p) / (b - a)) if b > a else F.lit(float(q)))
    return out.when(x.isNotNull(), F.lit(float(ys[-1])))


def confidence(p: Column, xs: list[float], ys: list[float]) -> Column:
    """The calibrated probability to the nearest 0.05."""
    return F.round(F.round(interpolated(p, xs, ys) / 0.05, 0) * 0.05, 2)


def ordered(rows: DataFrame) -> DataFrame:
    """Adds order: percentile of relevance times weakness."""
    return percentile_ranked(rows, "relevance", "__pct").withColumn("order", F.coalesce("__pct", F.lit(0.0)) * weakness()).drop("__pct")


def area_quota(rows: DataFrame, area: str, score: str, keep: float) -> DataFrame:
    """Rows in the upper `keep` part of their area by percentile."""
    return rows.withColumn("pct", percentile_rank(score, (area,))).where(F.col("pct") >= 1 - keep)


def top_per(rows: DataFrame, by: list[str], order: list[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group in an order."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def top_union(rows: DataFrame, by: str, score: str, key: str, k_each: int, k_all: int) -> DataFrame:
    """Top per group and top over all, each key once; the group's source wins."""
    order = [F.desc(score), F.asc(key)]
    each = top_per(rows, [by], order, k_each).withColumn("source", F.lit("group"))
    every = rows.orderBy(*order).limit(k_all).withColumns({"rank": F.lit(0), "source": F.lit("all")})
    both = each.unionByName(every)
    return both.groupBy(key).agg(F.min_by("source", F.when(F.col("source") == "group", 0).otherwise(1)).alias("source"), F.max(score).alias(score))


def diversified(rows: DataFrame, score: str, head: str, key: str, penalty: float = 0.55) -> DataFrame:
    """Adds adjusted and place: the greedy choice that discounts a head's later rows is, for rows sorted within their
    head, one sort by the discounted score."""
    nth = F.row_number().over(W.partitionBy(head).orderBy(F.desc(score), F.asc(key)))
    return numbered(rows.withColumn("adjusted", F.round(F.col(score) * F.pow(F.lit(penalty), nth - 1), 9)), [F.desc("adjusted"), F.asc(key)], "place")


def retrieval_metrics(ranks: DataFrame, k: int = 10) -> DataFrame:
    """(recall, mrr, ndcg) of (query, rank), rank NULL where the record wasn't found; one relevant record each."""
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    return ranks.agg(F.avg(hit.cast("double")).alias("recall"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("ndcg"))


def precision_lift(rows: DataFrame, score: str, label: str, key: str, k: int) -> DataFrame:
    """(precision, base, lift, recall) of the top k by score."""
    base = rows.agg(F.avg(F.col(label).cast("double")).alias("base"), F.sum(F.col(label).cast("long")).alias("positives"))
    top = rows.orderBy(F.desc(score), key).limit(k).agg(F.avg(F.col(label).cast("double")).alias("precision"), F.sum(F.col(label).cast("long")).alias("hits"))
    return top.join(F.broadcast(base)).select("precision", "base", F.try_divide("precision", "base").alias("lift"), F.try_divide("hits", "positives").alias("recall"))


def rank_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): by the rank sum, ties averaged; NULL where only one class is there."""
    # A mean rank is the percentile times the number of rows.
    n = rows.agg(F.count(score).alias("__n"))
    r = percentile_ranked(rows.select(F.col(label).cast("int").alias("y"), F.col(score)), score, "__pct").join(F.broadcast(n)).select("y", (F.col("__pct") * F.col("__n")).alias("r"))
    n1, n0 = F.sum("y"), F.sum(1 - F.col("y"))
    return r.agg(F.try_divide(F.sum(F.when(F.col("y") == 1, F.col("r")).otherwise(0.0)) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def covers(p: Column, q: Column) -> Column:
    """p holds in q with at least 60 % of its words and two of them, or q holds in p."""
    sub = lambda a, b: F.size(F.array_except(a, b)) == 0
    return (sub(p, q) & (F.size(p) >= F.greatest(F.lit(2), F.ceil(0.6 * F.size(q)).cast("int")))) | sub(q, p)


def is_duplicate(p: Column, q: Column, similarity: Column) -> Column:
    """Word sets p, q (arrays in phrase order): subset; two thirds shared and one head; a shared word and .80; or .88."""
    shared = F.size(F.array_intersect(p, q))
    subset = (F.size(F.array_except(p, q)) == 0) | (F.size(F.array_except(q, p)) == 0)
    head = F.element_at(p, -1) == F.element_at(q, -1)
    return subset | ((shared * 3 >= 2 * F.greatest(F.size(p), F.size(q))) & head) | ((shared > 0) & (similarity >= 0.8)) | (similarity >= 0.88)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
