"""Building the base of signals: selection, transfer of labels, cascade, completeness, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glimmer.operators import rank as R
from glimmer.operators.grouping import contained
from glimmer.operators.vectors import greedy_kept


def decile_strata(rows: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    """Adds stratum (0 to n - 1) by quantile edges of the rank, first come by key on ties."""
    placed = R.numbered(rows, [F.col(value), F.col(key)], "__at")
    count = placed.agg(F.count(F.lit(1)).alias("__count"))
    # Edges of n equal parts of the ranks 1..N, the lower edge of a part open.
    stratum = F.greatest(F.ceil((F.col("__at") - 1) * n / F.nullif(F.col("__count") - 1, F.lit(0))) - 1, F.lit(0)).cast("int")
    return placed.join(F.broadcast(count)).withColumn("stratum", F.coalesce(stratum, F.lit(0))).drop("__at", "__count")


def with_quota(rows: DataFrame, quotas: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Each group's first rows, as many as its quota (group, quota); groups without one get none."""
    return R.top_per(rows.join(quotas, group), [group], order, F.col("quota")).drop("quota")


def nested_dedup(terms: DataFrame, near: float = 0.25) -> DataFrame:
    """Terms (term, score, support) without those that hold or are held by a better one of nearly their support.

    Holding is by words: every contiguous part of a term is looked up, so that no pair is formed without a hit.
    """
    w = F.split("term", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
    inner = terms.select(F.col("term").alias("a"), F.col("support").alias("sa"), F.explode(F.array_distinct(parts)).alias("b")).where("a <> b").join(terms.select(F.col("term").alias("b"), F.col("support").alias("sb")), "b")
    close = inner.where(F.abs(F.col("sa") - F.col("sb")) <= near * F.greatest("sa", "sb"))
    kept = greedy_kept(terms.select(F.col("term").alias("id"), (-F.col("score")).alias("rank")), close.select("a", "b"))
    return terms.join(kept.where("kept").select(F.col("id").alias("term")), "term", "left_semi")


def overlapping_dedup(terms: DataFrame, near: float = 0.5, share: float = 0.5) -> DataFrame:
    """Terms (term, score, support) without those that a better one of about their support covers: one holds the other as
    characters, or they share so large a part of the words of the shorter.

    Pairs are met by a word and the power of two of their support: far supports meet nowhere. near is 0.5 at most. A word
    that n terms of one support have makes pairs of them, so terms are candidates, not a whole vocabulary.
    """
    own = terms.select("term", F.col("support").cast("double").alias("n"), F.array_distinct(F.split("term", r"\s+")).alias("w"))
    # Supports within half of the larger are in the same or in neighbouring powers of two.
    level = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1.0)))).cast("int")
    side = lambda x, levels: own.select(F.col("term").alias(x), F.col("n").alias(f"n{x}"), F.col("w").alias(f"w{x}"), F.explode("w").alias("word"), levels.alias("level"))
    met = side("a", level).join(side("b", F.array(level, level + 1)).withColumn("level", F.explode("level")), ["word", "level"]).where("a <> b").dropDuplicates(["a", "b"])
    covers = F.size(F.array_intersect("wa", "wb")) >= share * F.least(F.size("wa"), F.size("wb"))
    close = F.abs(F.col("na") - F.col("nb")) <= near * F.greatest("na", "nb")
    inside = contained(terms, "term").join(own.select(F.col("term").alias("a"), F.col("n").alias("na")), "a").join(own.select(F.col("term").alias("b"), F.col("n").alias("nb")), "b")
    conflicts = met.where(covers & close).select("a", "b").unionByName(inside.where(close).select("a", "b"))
    kept = greedy_kept(terms.select(F.col("term").alias("id"), (-F.col("score")).alias("rank")), conflicts)
    return terms.join(kept.where("kept").select(F.col("id").alias("term")), "term", "left_semi")


def transferred(new: DataFrame, labelled: DataFrame, key: Column) -> DataFrame:
    """new with the verdict of an older version's row of the same key; the latest version's verdict wins."""
    old = labelled.withColumn("__key", key).groupBy("__key").agg(F.max_by("verdict", "version").alias("verdict"))
    return new.withColumn("__key", key).join(old, "__key", "left").drop("__key")


def cascade(rows: DataFrame, widths: tuple[int, int], score: str, key: str) -> DataFrame:
    """Adds stage: the last stage a candidate reached. Forced rejections leave at once; each further stage takes the best
    of those that are left, so many as its width."""
    first = lambda n: rows.where(~F.col("rejected")).orderBy(F.desc(score), key).limit(n).select(key)
    # As many rows as the widths say.
    best = first(widths[0]).withColumn("__two", F.lit(True)).join(first(widths[1]).withColumn("__three", F.lit(True)), key, "left")
    return rows.join(F.broadcast(best), key, "left").withColumn("stage", F.when(F.col("__three"), 3).when(F.col("__two"), 2).otherwise(1)).drop("__two", "__three")


def completeness_state(failures: DataFrame) -> DataFrame:
    """(query, state): PROVIDER_ERROR if any call failed for an outside reason, else INCOMPLETE_SEARCH if any was cut short
    inside, else COMPLETE. failures: (query, source, kind) with kind external, internal or NULL."""
    return failures.groupBy("query").agg(F.max(F.coalesce(F.col("kind") == "external", F.lit(False))).alias("e"), F.max(F.coalesce(F.col("kind") == "internal", F.lit(False))).alias("i")).select("query", F.when(F.col("e"), "PROVIDER_ERROR").when(F.col("i"), "INCOMPLETE_SEARCH").otherwise("COMPLETE").alias("state"))


def market_candidates(rows: DataFrame, tech: str, not_tech: str, known: DataFrame, since: int = 2023, k: int = 1500) -> DataFrame:
    """New, growing phrases with a technical word, without names of the news, digits, or an entry in known, by rank sums."""
    fine = (F.col("first_year") >= since) & (F.col("volume") >= 5) & (F.col("growth") >= 1.5) & F.col("phrase").rlike(tech) & ~F.col("phrase").rlike(not_tech) & ~F.col("phrase").rlike(r"\d")
    left = rows.where(fine).join(known.select("phrase").distinct(), "phrase", "left_anti")
    left = R.percentile_ranked(R.percentile_ranked(left, "volume", "__pv"), "growth", "__pg")
    return left.withColumn("rank", F.col("__pv") + F.col("__pg")).drop("__pv", "__pg").orderBy(F.desc(F.round("rank", 9)), "phrase").limit(k)


def blended(rows: DataFrame, expert: str, history: str, by_rank: bool = True) -> DataFrame:
    """rows with blend: 0.7 of the expert's and 0.3 of history's probability, as percentiles or as they are."""
    if not by_rank:
        return rows.withColumn("blend", 0.7 * F.col(expert) + 0.3 * F.col(history))
    ranked = R.percentile_ranked(R.percentile_ranked(rows, expert, "__pe"), history, "__ph")
    return ranked.withColumn("blend", 0.7 * F.col("__pe") + 0.3 * F.col("__ph")).drop("__pe", "__ph")


def signal_base(rows: DataFrame, keep: float, score: str = "blend") -> DataFrame:
    """Rows (phrase, area, fragment, umbrella, theory_share, known, blend) that pass the name rules, aren't theory or known,
    and are in the upper part of their area, with their tier within it."""
    fine = ~F.col("fragment") & ~F.col("umbrella") & (F.coalesce("theory_share", F.lit(0.0)) < 0.6) & ~F.col("known")
    top = R.area_quota(rows.where(fine), "area", score, keep)
    return top.withColumn("tier", F.when(F.col("pct") >= 1 - keep / 3, 1).when(F.col("pct") >= 1 - 2 * keep / 3, 2).otherwise(3))


def area_decision(votes: DataFrame, named: DataFrame, named_at: float, strong: float, mid_name: float, mid_vote: float) -> DataFrame:
    """(query_id, area): the area of the most similar name, if that or the neighbours' vote is strong enough, else NULL."""
    best = named.groupBy("query_id").agg(F.max_by("area", F.struct("similarity", "area")).alias("area"), F.max("similarity").alias("s"))
    rows = best.join(votes, ["query_id", "area"], "left").withColumn("v", F.coalesce("vote", F.lit(0.0)))
    ok = (F.col("s") >= named_at) | (F.col("v") >= strong) | ((F.col("s") >= mid_name) & (F.col("v") >= mid_vote))
    return rows.select("query_id", F.when(ok, F.col("area")).alias("area"))


def answer(rows: DataFrame, shown: int = 15) -> DataFrame:
    """One row of three lists from ranked rows (key, order, code): shown, more, and excluded with reasons, and counts."""
    first = lambda which: rows.where(which).orderBy(F.desc("order"), "key").limit(4 * shown)
    top = first(F.col("code").isNull()).unionByName(first(F.col("code").isNotNull()))
    place = F.row_number().over(W.partitionBy(F.col("code").isNull()).orderBy(F.desc("order"), "key"))
    part = top.withColumn("place", place).withColumn("list", F.when(F.col("code").isNotNull(), "excluded").when(F.col("place") <= shown, "shown").when(F.col("place") <= 4 * shown, "more"))
    few = part.where((F.col("list").isin("shown", "more")) | ((F.col("list") == "excluded") & (F.col("place") <= 4 * shown)))
    of = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("place", "key")))), lambda x: x["key"].cast("string")), ",").alias(name)
    lists = few.agg(of("shown"), of("more"), of("excluded"))
    return lists.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("code").isNotNull()).alias("n_excluded"))))


def features(rows: DataFrame) -> DataFrame:
    """Model features from raw counters, with defaults for what wasn't measured."""
    g = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d))
    return rows.select(
        "id",
        F.log1p(g("oa_total")).alias("oa_total_log"),
        g("oa_peak_ratio", 1.0).alias("oa_peak_ratio"),
        (g("news_30d") / F.greatest(F.lit(1.0), g("news_1y"))).alias("news_30d_share"),
        F.ln((g("hn_12m") + 1) / (g("hn_prior24m") / 2 + 1)).alias("hn_growth"),
        F.log1p(g("gh_total")).alias("gh_total_log"),
    )


def claim_table(docs: DataFrame, most: int = 5) -> DataFrame:
    """(claim, families, documents) from (id, family, claims array): families and the first documents of each claim."""
    rows = docs.select("id", "family", F.explode("claims").alias("claim"))
    fam = rows.groupBy("claim").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    top = R.top_per(rows, ["claim"], [F.asc("id")], most).groupBy("claim").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("documents"))
    return fam.join(top, "claim")


def held_out_title(titles: Column, used: int) -> Column:
    """The first title beyond those that were embedded, NULL if there is none."""
    return F.get(titles, F.lit(used))


def fingerprint(config: dict) -> str:
    """sha256 of a configuration as sorted JSON."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def industrial_candidates(rows: DataFrame, lexicon: str, assessed: DataFrame, mature: int = R.MATURE_YEAR, theory_max: float = 0.6, projects: int = 3, share: float = 0.3, k: int = 1500) -> DataFrame:
    """The k best of those not assessed yet that belong to industry, by a word of the lexicon, or by public projects and the
    share of industrial groups; without fragments, umbrella phrases, mature ones and theory.

    rows: (phrase, fragment, umbrella, projects, industry_share, first_year, theory_share, expert_p, history_p).
    """
    left = rows.join(assessed.select("phrase").distinct(), "phrase", "left_anti").where(~F.col("fragment") & ~F.col("umbrella"))
    left = left.withColumn("by_word", F.replace("phrase", F.lit("_"), F.lit(" ")).rlike(lexicon))
    belongs = F.col("by_word") | ((F.coalesce("projects", F.lit(0)) >= projects) & F.coalesce(F.col("industry_share") >= share, F.lit(False)))
    young, plain = ~F.coalesce(F.col("first_year") <= mature, F.lit(False)), ~F.coalesce(F.col("theory_share") >= theory_max, F.lit(False))
    made = blended(left.where(belongs & young & plain), "expert_p", "history_p")
    return made.where("blend IS NOT NULL").orderBy(F.desc(F.round("blend", 9)), "phrase").limit(k)


#: Words that don't make a quote be about a phrase; suffixes that are cut off; what a record starts from.
QUOTE_FILL = frozenset("ai llm llms for of the and based model models system systems learning large language".split())
QUOTE_SUFFIXES = ("ies", "es", "s", "ing", "ed")
RECORD_BASE, RECORD_SPAN, UNCONFIRMED_FACTOR = 0.55, 0.4, 0.7


def _quote_stems(text: Column) -> Column:
    def cut(w: Column) -> Column:
        out = w
        for suffix in reversed(QUOTE_SUFFIXES):
            out = F.when((F.length(w) > 4) & w.endswith(suffix), F.substr(w, F.lit(1), F.length(w) - len(suffix))).otherwise(out)
        return out

    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0), cut))


def quote_is_about(phrase: Column, quote: Column, similarity: Column, least: float = 0.40) -> Column:
    """The quote is close to the phrase, or holds half of its telling words (or there are none)."""
    w = F.filter(_quote_stems(F.replace(phrase, F.lit("_"), F.lit(" "))), lambda x: ~x.isin(*sorted(QUOTE_FILL)))
    shared = F.size(F.array_intersect(w, _quote_stems(quote)))
    return (similarity >= least) | (F.size(w) == 0) | (shared >= F.greatest(F.lit(1), F.floor((F.size(w) + 1) / 2).cast("int")))


def passport_scores(rows: DataFrame) -> DataFrame:
    """Adds score: of confirmed new records .55 and .4 of the rank of their growth among them; signals of the base whose
    sources don't confirm an event keep .7 of theirs. rows: (kind, confirmed, growth, expert), kind "base" or another."""
    new = rows.where((F.col("kind") != "base") & F.col("confirmed"))
    ranked = R.percentile_ranked(new, "growth", "__pct").withColumn("score", RECORD_BASE + RECORD_SPAN * F.col("__pct")).drop("__pct")
    old = rows.where(F.col("kind") == "base").withColumn("score", F.col("expert") * F.when(F.coalesce(~F.col("confirmed"), F.lit(False)), UNCONFIRMED_FACTOR).otherwise(1.0))
    return ranked.unionByName(old)
