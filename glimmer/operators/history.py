"""Point-in-time labels and outcomes: nothing that is called a feature looks past its cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glimmer.operators.rank import quantiles
from glimmer.operators.score import during
from glimmer.operators.windows import Params

GRADES = ("AAA", "AA", "A", "BBB", "BB", "B", "CCC")
#: Shares of the grades from the top; the rest is the last grade.
GRADE_SHARES = (0.02, 0.03, 0.05, 0.10, 0.20, 0.30)


def _window_share(cube: DataFrame, totals: DataFrame, years: tuple[int, int], name: str) -> DataFrame:
    n = totals.agg(F.greatest(during("n_docs", years), F.lit(1)).alias("n"))
    own = cube.groupBy("entity").agg(during("df", years).cast("long").alias(f"d_{name}"))
    return own.join(F.broadcast(n)).select("entity", f"d_{name}", (F.col(f"d_{name}") / F.col("n")).alias(f"s_{name}"))


def event_time(series: DataFrame, yearly: DataFrame, p: Params, last: int) -> DataFrame:
    """(entity, t_event): years after the cutoff until the three-year share is p.takeoff times that at the cutoff, with
    p.min_future documents; 0 if not by `last`. series: dense (entity, year, docs); yearly: (year, n)."""
    by, every = W.partitionBy("entity").orderBy("year").rowsBetween(-2, 0), W.partitionBy(F.lit(0)).orderBy("year").rowsBetween(-2, 0)
    n3 = yearly.select("year", F.greatest(F.sum("n").over(every), F.lit(1)).alias("n3"))
    rows = series.select("entity", "year", F.sum("docs").over(by).alias("d")).join(n3, "year").withColumn("s", F.col("d") / F.col("n3"))
    at = rows.where(F.col("year") == p.cutoff).select("entity", F.col("s").alias("s0"))
    hit = ((F.col("s") + 1e-9) / (F.col("s0") + 1e-9) >= p.takeoff) & (F.col("d") >= p.min_future)
    after = rows.where(F.col("year").between(p.cutoff + 1, last)).join(at, "entity").groupBy("entity").agg(F.min(F.when(hit, F.col("year") - p.cutoff)).alias("t"))
    return at.join(after, "entity", "left").select("entity", F.coalesce("t", F.lit(0)).cast("int").alias("t_event"))


def takeoff_label(cube: DataFrame, totals: DataFrame, p: Params, future: tuple[int, int]) -> DataFrame:
    """(entity, d_now, d_future, takeoff): the future share is p.takeoff times the present one, with enough documents."""
    rows = _window_share(cube, totals, p.recent, "now").join(_window_share(cube, totals, future, "future"), "entity")
    return rows.select("entity", "d_now", "d_future", (((F.col("s_future") + 1e-9) / (F.col("s_now") + 1e-9) >= p.takeoff) & (F.col("d_future") >= p.min_future)).alias("takeoff"))


def small_takeoff(labels: DataFrame, most: int, incremental: Column, inc_max: float = 3.0) -> DataFrame:
    """The label for small entities that don't merely improve a known one."""
    return labels.withColumn("takeoff", F.col("takeoff") & (F.col("d_now") <= most) & F.coalesce(incremental < inc_max, F.lit(True)))


def person_period(events: DataFrame, horizon: int) -> DataFrame:
    """(entity, t, event): a row for each year at risk, up to the event or the horizon."""
    upto = F.when(F.col("t_event") > 0, F.least("t_event", F.lit(horizon))).otherwise(F.lit(horizon))
    return events.select("entity", "t_event", F.explode(F.sequence(F.lit(1), upto)).alias("t")).select("entity", "t", (F.col("t") == F.col("t_event")).cast("int").alias("event"))


def cumulative_hazard(hazards: DataFrame) -> DataFrame:
    """(entity, t, p): probability of the event by t from yearly hazards h below 1."""
    by = W.partitionBy("entity").orderBy("t")
    return hazards.select("entity", "t", (1 - F.exp(F.sum(F.log1p(-F.col("h"))).over(by))).alias("p"))


def takeoff_year(cumulative: DataFrame, at: float = 0.5) -> DataFrame:
    """(entity, half): the first t with p of at least that much; NULL if none."""
    return cumulative.groupBy("entity").agg(F.min(F.when(F.col("p") >= at, F.col("t"))).alias("half"))


def grades(scores: DataFrame, domain: str, least: int = 300) -> DataFrame:
    """Adds grade to (entity, domain, p): edges are quantiles of the domain, or of all where it has fewer rows."""
    points, total = [], 0.0
    for s in GRADE_SHARES:
        total += s
        points.append(round(1 - total, 10))
    own = scores.groupBy(domain).agg(F.percentile("p", F.array(*[F.lit(x) for x in points])).alias("own"), F.count(F.lit(1)).alias("n"))
    every = quantiles(scores, "p", points).withColumnRenamed("q", "every")
    rows = scores.join(own, domain, "left").join(F.broadcast(every)).withColumn("edges", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("every")))
    index = F.size(F.filter("edges", lambda e: e >= F.col("p")))
    return rows.select(*scores.columns, F.array(*[F.lit(g) for g in GRADES])[index].alias("grade"))


def migrants(series: DataFrame, cutoff: int, hist_min: int = 5, target_hist_max: int = 1, target_min: int = 5, target_share: float = 0.2) -> DataFrame:
    """(entity, migrant, home, target, target_recent, recent_total, hist_total) from (entity, science, year, n).

    home is the science with most history; a target is another with next to none that holds enough of the recent
    documents. Ties go to the science first by name.
    """
    cell = series.groupBy("entity", "science").agg(F.coalesce(F.sum(F.when(F.col("year") <= cutoff - 3, F.col("n"))), F.lit(0)).alias("h"), F.coalesce(F.sum(F.when(F.col("year").between(cutoff - 2, cutoff), F.col("n"))), F.lit(0)).alias("r"))
    by = W.partitionBy("entity")
    cell = cell.withColumns({"ht": F.sum("h").over(by), "rt": F.sum("r").over(by), "home": F.min_by("science", F.struct(-F.col("h"), F.col("science"))).over(by)})
    new = (F.col("h") <= target_hist_max) & (F.col("r") >= target_min) & (F.col("r") >= target_share * F.greatest(F.col("rt"), F.lit(1))) & (F.col("science") != F.col("home")) & (F.col("ht") >= hist_min)
    key = F.when(new, F.struct(-F.col("r"), F.col("science")))
    rows = cell.groupBy("entity", "home", "rt", "ht").agg(F.min(key).alias("k"))
    return rows.select("entity", F.col("k").isNotNull().alias("migrant"), "home", F.coalesce("k.science", F.lit("")).alias("target"), F.coalesce(-F.col("k.col1"), F.lit(0)).cast("long").alias("target_recent"), F.col("rt").cast("long").alias("recent_total"), F.col("ht").cast("long").alias("hist_total"))


def group_share(groups: DataFrame, chosen: Column, least: int = 5) -> DataFrame:
    """(entity, share): documents in chosen groups over all; NULL below `least` documents. groups: (entity, grp, df)."""
    total = F.sum("df")
    return groups.groupBy("entity").agg(F.when(total >= least, F.sum(F.when(chosen, F.col("df")).otherwise(F.lit(0))) / total).alias("share"))


def mass_year(cube: DataFrame, totals: DataFrame, cutoff: int, mass: float = 1e-3) -> DataFrame:
    """(entity, mass_year, lead_years): the first year after the cutoff in which some source's share is mass."""
    share = cube.join(totals, ["source", "year"]).withColumn("s", F.col("df") / F.greatest("n_docs", F.lit(1)))
    first = F.min(F.when((F.col("year") > cutoff) & (F.col("s") >= mass), F.col("year")))
    return share.groupBy("entity").agg(first.cast("int").alias("mass_year"), (first - cutoff).cast("int").alias("lead_years"))


def features_at(series: DataFrame, at: int) -> DataFrame:
    """(entity, recent_mean, prior_mean, age, peak_ratio, last_share, dormancy, accel) as of a year, from
    (entity, year, docs), dense; only years up to it are read."""
    rows = series.where(F.col("year") <= at)
    mean = lambda a, b: F.coalesce(F.sum(F.when(F.col("year").between(a, b), F.col("docs"))), F.lit(0)) / (b - a + 1)
    on = lambda y: F.coalesce(F.sum(F.when(F.col("year") == y, F.col("docs"))), F.lit(0))
    started = F.min(F.when(F.col("docs") >= 1, F.col("year")))
    peak = F.max(F.when(F.col("year") < at, F.col("docs")))
    gap = F.max(F.when((F.col("docs") > 0) & (F.col("year") < at), F.col("year")))
    return rows.groupBy("entity").agg(
        mean(at - 2, at).alias("recent_mean"),
        mean(at - 7, at - 5).alias("prior_mean"),
        (at - started).cast("int").alias("age"),
        F.when(peak > 0, on(at) / peak).alias("peak_ratio"),
        F.try_divide(on(at), F.sum("docs")).alias("last_share"),
        (at - 1 - gap).cast("int").alias("dormancy"),
        (F.log1p(on(at).cast("double")) - 2 * F.log1p(on(at - 1).cast("double")) + F.log1p(on(at - 2).cast("double"))).alias("accel"),
    )


def ladder(firsts: DataFrame, at: Column) -> DataFrame:
    """(entity, step): number of layers reached by then."""
    return firsts.groupBy("entity").agg(F.count_if(F.col("first") <= at).alias("step"))


def z_score(rows: DataFrame, value: str, by: tuple[str, ...], name: str = "z") -> DataFrame:
    """Adds the z-score within groups, by the sample deviation; 0 where there is none."""
    each = rows.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return rows.join(each, list(by)).withColumn(name, F.coalesce((F.col(value) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)), F.lit(0.0))).select(*rows.columns, name)


def bursts(series: DataFrame, groups: DataFrame, recent: tuple[int, int], prior: tuple[int, int], most_prior: int, least_recent: int, max_entropy: float) -> DataFrame:
    """(entity, recent, prior, entropy, score): few documents before, many now, in few groups (entity, grp, df)."""
    own = series.groupBy("entity").agg(during("docs", recent).cast("long").alias("recent"), during("docs", prior).cast("long").alias("prior"))
    total = groups.groupBy("entity").agg(F.sum("df").alias("t"), F.sum(F.col("df") * F.ln("df")).alias("s"), F.count(F.lit(1)).alias("k"))
    entropy = total.select("entity", F.when(F.col("k") > 1, (F.ln("t") - F.col("s") / F.col("t")) / F.ln("k")).otherwise(F.lit(0.0)).alias("entropy"))
    rows = own.join(entropy, "entity").where((F.col("prior") <= most_prior) & (F.col("recent") >= least_recent) & (F.col("entropy") <= max_entropy))
    return rows.withColumn("score", F.log2((F.col("recent") + 1) / (F.col("prior") + 1)) * F.ln("recent") * (1 - F.col("entropy")))


def rank_stability(ranks: DataFrame, n_runs: int, top: int) -> DataFrame:
    """(entity, runs_seen, rank_median, rank_min, rank_max, stable) of ranks over runs; absent counts as top + 1."""
    padded = F.concat(F.collect_list(F.col("rank").cast("double")), F.array_repeat(F.lit(float(top + 1)), F.lit(n_runs) - F.count(F.lit(1)).cast("int")))
    rows = ranks.groupBy("entity").agg(F.count(F.lit(1)).alias("runs_seen"), F.array_sort(padded).alias("r"), F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"))
    middle = (F.col("r")[(n_runs - 1) // 2] + F.col("r")[n_runs // 2]) / 2
    return rows.select("entity", "runs_seen", middle.alias("rank_median"), "rank_min", "rank_max", (F.col("runs_seen") * 2 >= n_runs).alias("stable"))
