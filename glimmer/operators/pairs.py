"""Combinations and rollups: co-occurring terms, method by object, projects, funding, actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glimmer.operators.score import during
from glimmer.operators.windows import Params


def rarest(found: DataFrame, df: DataFrame, most: int = 25) -> DataFrame:
    """(doc_id, year, terms): each document's rarest terms, ties by name, as a sorted array."""
    rows = found.join(df.select("entity", "df"), "entity")
    terms = F.slice(F.array_sort(F.collect_set(F.struct("df", "entity"))), 1, most)
    return rows.groupBy("doc_id", "year").agg(F.array_sort(F.transform(terms, lambda t: t["entity"])).alias("terms"))


def pairs(docs: DataFrame) -> DataFrame:
    """(a, b, year): pairs a < b of one document's terms that share no word, from bounded arrays, without a join."""
    t = F.col("terms")
    words = lambda x: F.split(x, " ")
    made = F.flatten(F.transform(t, lambda a, i: F.transform(F.filter(t, lambda b: (b > a) & ~F.arrays_overlap(words(a), words(b))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return docs.select("year", F.explode(made).alias("p")).select("p.a", "p.b", "year")


def pair_growth(found: DataFrame, p: Params, least: int = 5, min_growth: float = 2.0) -> DataFrame:
    """(a, b, r, base, growth, score): pairs frequent in the recent window that grew, with +1 smoothing."""
    rows = found.groupBy("a", "b").agg(during(F.lit(1), p.recent).cast("long").alias("r"), during(F.lit(1), p.base).cast("long").alias("base")).where(F.col("r") >= least)
    rows = rows.withColumn("growth", F.log2((F.col("r") + 1) / (F.col("base") + 1))).where(F.col("growth") >= min_growth)
    return rows.withColumn("score", F.least("growth", F.lit(8.0)) - 0.5 * F.log10(F.greatest(F.col("r") / 200, F.lit(1.0))))


def established(sums: DataFrame, min_docs: int, max_growth: float) -> DataFrame:
    """Entities (entity, volume, growth) that are large and no longer grow: parts for combinations."""
    return sums.where((F.col("volume") >= min_docs) & (F.coalesce("growth", F.lit(0.0)) <= max_growth))


def cross(docs: DataFrame, methods: dict[str, str], objects: dict[str, str], text: str = "text") -> DataFrame:
    """Every method and object whose pattern a document matches: docs' columns but the text, method, object."""
    hits = lambda rules: F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in rules.items()]))
    rows = docs.withColumns({"__m": hits(methods), "__o": hits(objects)}).where((F.size("__m") > 0) & (F.size("__o") > 0))
    kept = [c for c in docs.columns if c != text]
    return rows.select(*kept, "__o", F.explode("__m").alias("method")).select(*kept, "method", F.explode("__o").alias("object"))


def cross_series(found: DataFrame, totals: DataFrame, p: Params, examples: int = 8) -> DataFrame:
    """(method, object, r, base, growth, first_year, examples) of crossed documents (doc_id, year); totals: (year, n)."""
    n = totals.agg(during("n", p.recent).alias("nr"), during("n", p.base).alias("nb"))
    yearly = found.groupBy("method", "object", "year").agg(F.count(F.lit(1)).alias("n"))
    rows = yearly.groupBy("method", "object").agg(during("n", p.recent).cast("long").alias("r"), during("n", p.base).cast("long").alias("base"), F.min(F.when(F.col("n") >= 3, F.col("year"))).cast("int").alias("first_year"))
    ranked = found.withColumn("k", F.row_number().over(W.partitionBy("method", "object").orderBy(F.desc("year"), "doc_id"))).where(F.col("k") <= examples)
    shown = ranked.groupBy("method", "object").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("examples"))
    share = lambda k, n: F.try_divide(F.col(k), F.col(n)) + 1e-9
    grown = F.log2(share("r", "nr") / share("base", "nb"))
    return rows.join(F.broadcast(n)).join(shown, ["method", "object"]).select("method", "object", "r", "base", grown.alias("growth"), "first_year", "examples")


def projects(rows: DataFrame, p: Params, top: int = 5) -> DataFrame:
    """(key, total, recent, base, first, money, best): projects (key, year, money, project) per key, with the newest and
    largest of them."""
    own = rows.groupBy("key").agg(F.count(F.lit(1)).alias("total"), during(F.lit(1), p.recent).cast("long").alias("recent"), during(F.lit(1), p.base).cast("long").alias("base"), F.min("year").cast("int").alias("first"), F.sum("money").alias("money"))
    return own.join(top_list(rows, "key", [F.desc("year"), F.desc("money"), F.asc("project")], "project", top, "best"), "key")


def top_list(rows: DataFrame, key: str, order: list[Column], show: str, top: int, name: str) -> DataFrame:
    """(key, name): the first `top` values of a column in an order, comma-joined; only they leave the window."""
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("k") <= top)
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(show).cast("string").alias("v")))), lambda x: x["v"]), ",").alias(name))


def funding(raises: DataFrame, recent_from: Column) -> DataFrame:
    """(key, companies, funded_recent, amount, first_raise) from (key, company, amount, at)."""
    return raises.groupBy("key").agg(F.countDistinct("company").alias("companies"), F.countDistinct(F.when(F.col("at") >= recent_from, F.col("company"))).alias("funded_recent"), F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"), F.min("at").alias("first_raise"))


def actors(works: DataFrame, country: str = "CN", top: int = 6) -> DataFrame:
    """(key, n_orgs, n_countries, country_share, best) from works (key, org, country): organisations with most works."""
    own = works.groupBy("key", "org", "country").agg(F.count(F.lit(1)).alias("works"))
    rows = own.groupBy("key").agg(F.countDistinct("org").alias("n_orgs"), F.countDistinct("country").alias("n_countries"), (F.sum(F.when(F.col("country") == country, F.col("works")).otherwise(F.lit(0))) / F.sum("works")).alias("country_share"))
    return rows.join(top_list(own, "key", [F.desc("works"), F.asc("org")], "org", top, "best"), "key")


def set_overlap(members: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, shared, overlap): sets (card, doc_id) that share at least that part of the smaller one."""
    size = members.groupBy("card").agg(F.countDistinct("doc_id").alias("n"))
    x, y = members.select(F.col("card").alias("a"), "doc_id").distinct(), members.select(F.col("card").alias("b"), "doc_id").distinct()
    both = x.join(y, "doc_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    rows = both.join(size.withColumnsRenamed({"card": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"card": "b", "n": "nb"}), "b")
    return rows.select("a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("overlap")).where(F.col("overlap") >= least)


def ctfidf(terms: DataFrame, top: int = 6) -> DataFrame:
    """(cluster, rank, term, weight): tf over cluster length times ln(1 + mean length over term frequency), from
    (cluster, term, tf)."""
    length = terms.groupBy("cluster").agg(F.sum("tf").alias("length"))
    mean = length.agg(F.avg("length").alias("mean"))
    freq = terms.groupBy("term").agg(F.sum("tf").alias("freq"))
    rows = terms.join(length, "cluster").join(freq, "term").join(F.broadcast(mean))
    rows = rows.withColumn("weight", F.col("tf") / F.col("length") * F.ln(1 + F.col("mean") / F.col("freq")))
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc(F.round("weight", 9)), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("cluster", "rank", "term", "weight")


def keyness(asked: DataFrame, background: DataFrame, n_asked: int | Column, n_background: int | Column) -> DataFrame:
    """(phrase, dfq, dfb, keyness): log ratio of shares in the query's documents and the background."""
    rows = asked.select("phrase", F.col("df").alias("dfq")).join(background.select("phrase", F.col("df").alias("dfb")), "phrase", "left").fillna({"dfb": 0})
    as_col = lambda n: n if isinstance(n, Column) else F.lit(n)
    return rows.withColumn("keyness", F.ln((F.try_divide("dfq", as_col(n_asked)) + 1e-4) / (F.try_divide("dfb", as_col(n_background)) + 1e-4)))
