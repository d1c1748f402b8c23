"""Features, labels and cards of terms as of a year, from dated documents with topics, organisations and venues.

Nothing here reads a document after the year asked about, except the labels, which are about what came later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.operators.pairs import top_list


def term_features(found: DataFrame, docs: DataFrame, at: int, first: int, top_orgs: int = 100) -> DataFrame:
    """Features of each term as of a year.

    found: (entity, doc_id, in_title); docs: (doc_id, year, topic, org, country, venue, domain, industry, preprint, home) with
    booleans for the last three. Years before first don't exist: means go over those that do.
    """
    past = docs.where((F.col("year") <= at) & (F.col("year") >= first))
    per_year = past.groupBy("year").agg(F.count(F.lit(1)).alias("n_year"))
    elite = past.groupBy("org").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "org").limit(top_orgs).select("org", F.lit(True).alias("elite"))
    rows = found.join(past, "doc_id").join(F.broadcast(elite), "org", "left").join(F.broadcast(per_year), "year")
    recent, prior = [y for y in range(at - 2, at + 1) if y >= first], [y for y in range(at - 5, at - 2) if y >= first]
    during = lambda ys: F.sum(F.col("year").isin(*ys).cast("int")) if ys else F.lit(0)
    rate = lambda ys: F.sum(F.when(F.col("year").isin(*ys), 1000 / F.col("n_year")).otherwise(0.0)) / len(ys) if ys else F.lit(0.0)
    share = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")) / F.count(F.lit(1))
    on = lambda y: F.log1p(F.sum((F.col("year") == y).cast("int")).cast("double"))
    own = rows.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_docs"),
        during(recent).alias("recent_docs"),
        rate(recent).alias("recent_rate"),
        during(prior).alias("prior_docs"),
        rate(prior).alias("prior_rate"),
        (on(at) - 2 * on(at - 1) + on(at - 2)).alias("accel"),
        F.sum((F.col("year") == at).cast("int")).alias("now"),
        (at - F.min("year")).cast("int").alias("first_year_age"),
        F.countDistinct("year").cast("int").alias("active_years"),
        F.countDistinct("topic").cast("int").alias("n_topics"),
        (F.countDistinct("org") / F.count(F.lit(1))).alias("org_per_doc"),
        F.countDistinct("country").cast("int").alias("n_countries"),
        F.countDistinct("domain").cast("int").alias("domain_spread"),
        (F.countDistinct("venue") / F.count(F.lit(1))).alias("venue_per_doc"),
        share("home").alias("home_share"),
        share("industry").alias("industry_share"),
        share("elite").alias("elite_share"),
        share("preprint").alias("preprint_share"),
        F.sum(F.col("in_title").cast("int")).alias("title_docs"),
    )
    cells = rows.groupBy("entity", "topic").agg(F.count(F.lit(1)).alias("c"))
    entropy = cells.groupBy("entity").agg((F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")).alias("e"))
    topics = past.agg(F.countDistinct("topic").alias("all_topics"))
    full = own.join(entropy, "entity").join(F.broadcast(topics))
    widest = F.ln(F.greatest(F.lit(2), F.least("n_docs", "all_topics")).cast("double"))
    return full.select(
        "entity",
        "n_docs",
        *[F.col(c).cast("long").alias(c) for c in ("recent_docs", "prior_docs", "title_docs")],
        "recent_rate",
        "prior_rate",
        F.ln((F.col("recent_rate") + 0.5) / (F.col("prior_rate") + 0.5)).alias("growth"),
        "accel",
        (F.col("now") / F.greatest("recent_docs", F.lit(1))).alias("last_share"),
        "first_year_age",
        F.greatest(F.lit(0), F.col("first_year_age") + 1 - F.col("active_years")).alias("dormancy"),
        "active_years",
        (F.col("e") / widest).alias("topic_entropy"),
        *("n_topics", "org_per_doc", "n_countries", "home_share", "industry_share", "elite_share", "preprint_share"),
        (F.col("title_docs") / F.col("n_docs")).alias("title_share"),
        *("domain_spread", "venue_per_doc"),
    )


def in_population(recent_min: int = 10, prior_max: int = 15, title_docs_min: int = 3, title_share_min: float = 0.25) -> Column:
    """Terms seen often lately, seldom before, and in titles."""
    return (F.col("recent_docs") >= recent_min) & (F.col("prior_docs") <= prior_max) & (F.col("title_docs") >= title_docs_min) & (F.col("title_share") >= title_share_min)


def rate_label(series: DataFrame, yearly: DataFrame, at: int, last: int, times: float = 2.0, least: int = 15) -> DataFrame:
    """(entity, ratio, outcome_docs, takeoff): documents a thousand, three to five years after over the three years up to a
    year, `times` as many and `least` documents at least. series: dense (entity, year, docs); yearly: (year, n)."""
    rows = series.join(F.broadcast(yearly), "year").withColumn("r", F.col("docs") / F.greatest("n", F.lit(1)) * 1000)
    now, later = F.col("year").between(at - 2, at), F.col("year").between(at + 3, min(at + 5, last))
    n = min(at + 5, last) - (at + 3) + 1
    own = rows.groupBy("entity").agg((F.sum(F.when(now, F.col("r")).otherwise(0.0)) / 3).alias("base"), (F.sum(F.when(later, F.col("r")).otherwise(0.0)) / n).alias("outcome"), F.sum(F.when(later, F.col("docs")).otherwise(0)).cast("long").alias("outcome_docs"))
    ratio = F.col("outcome") / F.greatest("base", F.lit(1e-9))
    return own.select("entity", ratio.alias("ratio"), "outcome_docs", ((ratio >= times) & (F.col("outcome_docs") >= least)).alias("takeoff"))


def count_label(series: DataFrame, at: int, last: int, times: float = 3.0, least: int = 15) -> DataFrame:
    """(entity, ratio, takeoff): the same by counts, with half a document added to both means."""
    now, later = F.col("year").between(at - 2, at), F.col("year").between(at + 3, min(at + 5, last))
    n = min(at + 5, last) - (at + 3) + 1
    own = series.groupBy("entity").agg((F.sum(F.when(now, F.col("docs")).otherwise(0)) / 3).alias("base"), F.sum(F.when(later, F.col("docs")).otherwise(0)).alias("future"))
    ratio = (F.col("future") / n + 0.5) / (F.col("base") + 0.5)
    return own.select("entity", ratio.alias("ratio"), ((ratio >= times) & (F.col("future") >= least)).alias("takeoff"))


def signal_cards(found: DataFrame, docs: DataFrame, last: int, home: str, partial: float = 1.0, top: int = 5) -> DataFrame:
    """A card for each term: its growth, birth, where it is done, whether industry has it, what speaks for it, examples.

    found: (entity, doc_id, votes); docs: (doc_id, year, country, org, industry, cited). The last year is partial: its
    count is multiplied. Growth compares the last three years with the three that end two years before them.
    """
    rows = found.join(docs, "doc_id")
    w = F.when(F.col("year") == last, F.lit(partial)).otherwise(F.lit(1.0))
    mean = lambda a, b: F.sum(F.when(F.col("year").between(a, b), w).otherwise(0.0)) / 3
    new = F.col("year") >= last - 2
    at_home = lambda part: F.sum(F.when(part & (F.col("country") == home), 1).otherwise(0)) / F.greatest(F.lit(1), F.sum(F.when(part & F.col("country").isNotNull(), 1).otherwise(0)))
    own = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_docs"), mean(last - 2, last).alias("r"), mean(last - 6, last - 4).alias("p"), at_home(new).alias("home_recent"), at_home(~new).alias("home_prior"), F.sum(F.when(F.col("year") == last, w).otherwise(0.0)).alias("now"), F.sum(F.when(F.col("year") == last - 2, 1).otherwise(0)).alias("before"))
    yearly = rows.groupBy("entity", "year").agg(F.sum(w).alias("n"))
    birth = yearly.groupBy("entity").agg(F.min(F.when(F.col("n") >= 3, F.col("year"))).cast("int").alias("birth_year"))
    orgs = rows.groupBy("entity", "org", "industry").agg(F.count(F.lit(1)).alias("k"))
    firms = orgs.where("industry").groupBy("entity").agg(F.countDistinct("org").alias("n_industry"))
    examples = top_list(rows, "entity", [F.desc("votes"), F.desc("cited"), F.desc("year"), F.asc("doc_id")], "doc_id", 3, "examples")
    best = top_list(orgs.groupBy("entity", "org").agg(F.sum("k").alias("k")), "entity", [F.desc("k"), F.asc("org")], "org", top, "top_orgs")
    first = top_list(orgs.where("industry").groupBy("entity", "org").agg(F.sum("k").alias("k")), "entity", [F.asc("org")], "org", 8, "industry")
    full = own.join(birth, "entity").join(firms, "entity", "left").join(best, "entity").join(first, "entity", "left").join(examples, "entity").fillna({"n_industry": 0, "industry": ""})
    says = F.array_compact(F.array(F.when(F.col("home_recent") - F.col("home_prior") >= 0.15, "home share rose"), F.when(F.col("n_industry") > 0, "industry has it").otherwise("academic so far"), F.when(F.col("now") > 2 * F.greatest(F.lit(1), F.col("before")), "yearly rate more than doubled")))
    return full.select("entity", "n_docs", "birth_year", F.ln((F.col("r") + 1) / (F.col("p") + 1)).alias("growth"), "home_recent", "home_prior", "n_industry", "industry", "top_orgs", "examples", F.array_join(says, "; ").alias("signals"))
