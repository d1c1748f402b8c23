"""Sinks: idempotent tables, append-only forecasts, caches whose last write wins, nested cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators.windows import Params


def replace_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Writes the whole table anew: loading twice is loading once."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_forecasts(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def last_writes(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def scored_forecasts(forecasts: DataFrame, yearly: DataFrame, this_year: int, horizon: tuple[int, int] = (3, 5), times: float = 3.0) -> DataFrame:
    """Forecasts (technology, year, baseline) against later counts (technology, year, n): hit if the mean over the outcome
    years that have passed, from three to five years after, is `times` the baseline; NULL while none has. A year without
    a count counts as none."""
    passed = F.least(F.col("year") + horizon[1], F.lit(this_year - 1)) - (F.col("year") + horizon[0]) + 1
    later = forecasts.join(yearly.withColumnsRenamed({"year": "y"}), "technology").where(F.col("y").between(F.col("year") + horizon[0], F.col("year") + horizon[1]) & (F.col("y") < this_year))
    own = later.groupBy("technology", "year").agg(F.sum("n").alias("n"))
    rows = forecasts.join(own, ["technology", "year"], "left").withColumn("outcome", F.when(passed > 0, F.coalesce("n", F.lit(0)) / passed))
    return rows.select("technology", "year", "baseline", "outcome", (F.col("outcome") >= times * F.col("baseline")).alias("hit"))


def cards(rows: DataFrame, series: DataFrame, sources: DataFrame, p: Params, key: str = "entity") -> DataFrame:
    """A nested card per entity: its facts, a dense yearly line, and sources; series: (entity, year, docs)."""
    line = series.where(F.col("year") <= p.cutoff).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "docs"))), lambda x: x["docs"]).alias("line"))
    own = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("layer", "rank", "title"))).alias("sources"))
    facts = F.array_compact(F.array(F.when(F.col("first_year") > 0, F.concat(F.lit("since "), F.col("first_year").cast("string"))), F.when(F.col("growth") >= 1, F.lit("at least doubled")), F.when(F.col("n_sources") > 1, F.concat(F.col("n_sources").cast("string"), F.lit(" sources")))))
    return rows.join(line, key, "left").join(own, key, "left").select(key, facts.alias("facts"), "line", "sources")


def ladder(layers: dict[str, tuple[Column, str]]) -> Column:
    """array<struct<layer, present, value>>: which layers a technology has reached, with their counts in words; a layer that
    wasn't measured (NULL) isn't present."""
    some = lambda n: F.coalesce(n > 0, F.lit(False))
    return F.array(*[F.struct(F.lit(k).alias("layer"), some(n).alias("present"), F.when(some(n), F.concat_ws(" ", n.cast("long").cast("string"), F.lit(unit))).otherwise("none").alias("value")) for k, (n, unit) in layers.items()])


def share_line(series: DataFrame, by: str = "entity") -> DataFrame:
    """(by, line): shares of a dense series (by, year, share) in ten thousandths, to three places, in order of years."""
    points = F.array_sort(F.collect_list(F.struct("year", F.round(F.col("share") * 10_000, 3).alias("v"))))
    return series.groupBy(by).agg(F.transform(points, lambda x: x["v"]).alias("line"))


def largest(parts: Column, top: int = 7) -> Column:
    """The parts of a score, array<struct<label, value>>, largest in size, to three places; ties by label, NULLs left out."""
    order = F.transform(F.filter(parts, lambda x: x["value"].isNotNull()), lambda x: F.struct((-F.abs(x["value"])).alias("size"), x["label"].alias("label"), F.round(x["value"], 3).alias("value")))
    return F.transform(F.slice(F.array_sort(order), 1, top), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value")))
