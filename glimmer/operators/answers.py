"""Smaller steps of an answer: merging variants, claims about documents, shortlists, verdicts, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.functions import text as X
from glimmer.operators import rank as R


def collapsed(rows: DataFrame, key: Column) -> DataFrame:
    """(key, lead, n_variants, sums of counts) of variants (phrase, verified, burst, lit, repo): verified first, then
    burst, then the shorter and alphabetically first phrase leads."""
    order = F.struct(F.when(F.col("verified"), 0).otherwise(1), -F.col("burst"), F.length("phrase"), F.col("phrase"))
    return rows.withColumn("key", key).groupBy("key").agg(F.min_by("phrase", order).alias("lead"), F.count(F.lit(1)).alias("n_variants"), F.sum("lit").cast("long").alias("lit"), F.sum("repo").cast("long").alias("repo"))


def duplicate_rate(rows: DataFrame, key: Column) -> DataFrame:
    return rows.agg((1 - F.try_divide(F.countDistinct(key), F.count(F.lit(1)))).alias("duplicate_rate"))


def _echoed(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0), " ")


def _quoted(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zа-я0-9]+"), 0), " ")


def echo_holds(echo: Column, phrase: Column) -> Column:
    """A model's line repeats the phrase it was asked about, alone or before the first dash between spaces."""
    said, own = F.coalesce(echo, F.lit("")), _echoed(phrase)
    return (_echoed(F.split(said, r"\s[\u2014\u2013-]\s", 2)[0]) == own) | (_echoed(said) == own)


def quote_holds(quote: Column, sources: Column, least: int = 3) -> Column:
    """A quote of at least three words that stands in one of the source titles, whatever the case and punctuation."""
    q = _quoted(quote)
    return (F.size(F.split(q, " ")) >= least) & F.exists(F.coalesce(sources, F.expr("cast(array() as array<string>)")), lambda s: F.contains(_quoted(s), q))


#: Fixed value: the verdict on a technology that everybody has.
EVERYDAY = "массовая"


def checked(rows: DataFrame) -> DataFrame:
    """Judged lines that repeat their phrase and have both verdicts, with quote_ok, the url if a source has it (else empty) and
    accepted: a signal on the topic, and where it was verified, confirmed by its sources, quoted word by word and not everyday.

    rows: (phrase, echo, signal, on_topic, verified, sources_confirm, mass, quote, url, titles, urls).
    """
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    fine = rows.where(echo_holds(F.col("echo"), F.col("phrase")) & F.col("signal").isNotNull() & F.col("on_topic").isNotNull())
    fine = fine.withColumns({"quote_ok": quote_holds(F.col("quote"), F.col("titles")), "url": F.when(F.coalesce(F.array_contains("urls", F.col("url")), F.lit(False)), F.col("url")).otherwise("")})
    proven = no("sources_confirm") & F.col("quote_ok") & F.coalesce(F.col("mass") != EVERYDAY, F.lit(True))
    return fine.withColumn("accepted", F.col("signal") & F.col("on_topic") & (~no("verified") | proven))


def shortlist(rows: DataFrame, k: int = 24) -> DataFrame:
    """The first k by burst times specificity, ties by phrase."""
    return rows.orderBy(F.desc(F.round(F.col("burst") * F.col("specificity"), 9)), "phrase").limit(k)


def percentile_in(scores: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """Adds percentile: the share of reference values at most as large."""
    seen = scores.select(F.col(value), F.lit(0).alias("__r")).unionByName(reference.select(F.col(value), F.lit(1).alias("__r"))).where(F.col(value).isNotNull())
    found = R.cumulated(seen.groupBy(value).agg(F.sum("__r").alias("__r")), value, "__r").select(F.col(value).alias("__v"), F.try_divide(F.col("__before") + F.col("__r"), F.col("__all")).alias("percentile"))
    return scores.join(found, F.col(value) == F.col("__v"), "left").drop("__v")


def labels(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(id, grp, y): both sides with their group, the id where there is none; a positive wins over a negative."""
    side = lambda df, y: df.select("id", F.coalesce("grp", "id").alias("grp"), F.lit(y).alias("y"))
    both = side(positives, 1).unionByName(side(negatives, 0))
    return both.groupBy("id").agg(F.max_by("grp", F.struct("y", "grp")).alias("grp"), F.max("y").alias("y"))


def tiered(rows: DataFrame, flags: list[str], soft: str, k: int = 15) -> DataFrame:
    """Rows without a duplicate mark whose flags all hold, then those that lack the soft one only; the first k by score."""
    hard = F.lit(True)
    for f in flags:
        if f != soft:
            hard = hard & F.col(f)
    tier = F.when(hard & F.col(soft), 1).when(hard, 2)
    return rows.where(F.col("dup_of").isNull()).withColumn("tier", tier).where(F.col("tier").isNotNull()).orderBy("tier", F.desc("score"), "id").limit(k)


def top_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(query, overlap): the share of the top k of two rankings (query, place, id) that they have in common."""
    top = lambda df, n: df.where(F.col("place") <= k).groupBy("query").agg(F.collect_set("id").alias(n))
    return top(a, "x").join(top(b, "y"), "query").select("query", (F.size(F.array_intersect("x", "y")) / k).alias("overlap"))


def import_votes(rows: DataFrame) -> DataFrame:
    """(id, keep, mark) from two verdicts (is_technology, kind) on each: rubrics go, tasks that aren't technologies go, the
    general are marked G."""
    drop = (F.col("kind") == "rubric") | (~F.col("is_technology") & F.col("kind").isin("rubric", "task"))
    return rows.select("id", (~drop).alias("keep"), F.when(~drop & ~F.col("is_technology"), "G").alias("mark"))


def measurement_line(series: DataFrame, layers: DataFrame, first: int = 2, early: str = "arxiv", wiki: Column | None = None) -> DataFrame:
    """(entity, line): documents a year, the first year of the earliest layer with `first` of them, documents of the other
    layers, and whether there is an article. series: dense (entity, year, docs); layers: (entity, layer, year, docs)."""
    years = series.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "docs"))), lambda x: F.concat_ws(": ", x["year"].cast("string"), x["docs"].cast("string"))), ", ").alias("years"))
    begun = layers.where((F.col("layer") == early) & (F.col("docs") >= first)).groupBy("entity").agg(F.min("year").alias("begun"))
    per = layers.where(F.col("layer") != early).groupBy("entity", "layer").agg(F.sum("docs").alias("n"))
    others = per.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "n"))), lambda x: F.concat_ws(": ", x["layer"], x["n"].cast("string"))), ", ").alias("others"))
    rows = years.join(begun, "entity", "left").join(others, "entity", "left")
    article = F.when(wiki if wiki is not None else F.lit(False), "yes").otherwise("no")
    parts = F.array_compact(F.array(F.concat(F.lit("by year "), "years"), F.concat(F.lit(f"first in {early} "), F.coalesce(F.col("begun").cast("string"), F.lit("never"))), F.col("others"), F.concat(F.lit("article "), article)))
    return rows.select("entity", F.array_join(parts, "; ").alias("line"))


def layer_sources(docs: DataFrame, order: dict[str, Column], other: Column, top: int = 3) -> DataFrame:
    """(key, layer, rank, title): the first titles of each layer (key, layer, title) in an order of its own, ascending, each
    title once whatever its case and punctuation. Layers that order doesn't name go by other."""
    by = other
    for layer, column in order.items():
        by = F.when(F.col("layer") == layer, column).otherwise(by)
    t = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    rows = docs.withColumns({"t": t, "__by": by}).where("t <> ''")
    once = R.top_per(rows, ["key", "layer", "t"], [F.asc("__by"), F.asc("title")], 1, "k").drop("k")
    return R.top_per(once, ["key", "layer"], [F.asc("__by"), F.asc("title")], top).select("key", "layer", "rank", "title")


def source_metrics(series: DataFrame, last: int, factor: float) -> DataFrame:
    """(entity, total, recent_mean, prior_mean, growth, age, peak_ratio, peak_year, last_share) from a dense series.

    The last year is partial and annualised by factor; the prior years are seven to five years before it. Age is from the
    first year of three documents, 0 without one; the peak and the last share are of completed years.
    """
    d = F.when(F.col("year") == last, F.col("docs") * factor).otherwise(F.col("docs").cast("double"))
    mean = lambda a, b: F.sum(F.when(F.col("year").between(a, b), d).otherwise(0.0)) / 3
    done = F.when((F.col("year") < last) & (F.col("docs") > 0), F.struct(F.col("docs").alias("docs"), (-F.col("year")).alias("y")))
    full = F.sum(F.when(F.col("year") == last - 1, F.col("docs")).otherwise(0))
    rows = series.groupBy("entity").agg(F.sum("docs").alias("total"), mean(last - 2, last).alias("recent_mean"), mean(last - 7, last - 5).alias("prior_mean"), F.coalesce(last - F.min(F.when(F.col("docs") >= 3, F.col("year"))), F.lit(0)).cast("int").alias("age"), F.max(done).alias("p"), full.alias("l"))
    peak = F.coalesce(F.col("p.docs"), F.lit(0))
    return rows.select("entity", "total", "recent_mean", "prior_mean", F.ln((F.col("recent_mean") + 1) / (F.col("prior_mean") + 1)).alias("growth"), "age", ((F.col("l") + 1) / (peak + 1)).alias("peak_ratio"), (-F.col("p.y")).alias("peak_year"), F.coalesce(F.try_divide("l", "total"), F.lit(0.0)).alias("last_share"))


def source_shares(found: DataFrame) -> DataFrame:
    """(entity, preprint_share, company_share, n_fields) from documents (entity, doc_id, kind, institutions, field): of all
    documents; of pairs of a document and a type of its institutions; distinct fields."""
    own = found.groupBy("entity", "doc_id").agg(F.max((F.col("kind") == "preprint").cast("int")).alias("p"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("institutions", F.expr("cast(array() as array<string>)"))))).alias("i"))
    shares = own.groupBy("entity").agg((F.sum(F.coalesce("p", F.lit(0))) / F.count(F.lit(1))).alias("preprint_share"), F.coalesce(F.try_divide(F.sum(F.array_contains("i", "company").cast("int")), F.sum(F.size("i"))), F.lit(0.0)).alias("company_share"))
    fields = found.where("field IS NOT NULL").groupBy("entity").agg(F.countDistinct("field").alias("n_fields"))
    return shares.join(fields, "entity", "left").withColumn("n_fields", F.coalesce("n_fields", F.lit(0)).cast("long"))


def benchmark_metrics(rows: DataFrame) -> DataFrame:
    """One row from (decision, state, label): precision of confirmed, useful watchlist, noise that was confirmed."""
    share = lambda part, good: F.avg(F.when(part, good.cast("double")))
    return rows.agg(share(F.col("state") == "confirmed", F.col("label")).alias("confirmed_precision"), share(F.col("state") == "watchlist", F.col("label")).alias("watchlist_useful"), F.count_if((F.col("state") == "confirmed") & ~F.col("label")).alias("noise_confirmed"))
