"""From documents and their phrases to document-frequency tables; long and sparse, never dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.functions import text as X


def dealt(docs: DataFrame) -> DataFrame:
    """docs dealt anew where they lie in fewer partitions than there are cores: taking phrases out of texts is worth more
    than a shuffle of a small table. A table of many partitions stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(4 * cores) if docs.rdd.getNumPartitions() < cores else docs


def vocabulary(docs: DataFrame, phrases: Column, doc: str = "doc_id", min_df: int = 3) -> DataFrame:
    """(phrase, df): document frequency of candidate phrases, at least min_df."""
    return docs.select(F.explode(F.array_distinct(phrases)).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)


def entity_fold(vocab: DataFrame) -> DataFrame:
    """(entity_key, name, df, n_variants): variants of a key; the most frequent names it, ties alphabetically."""
    keyed = vocab.withColumn("entity_key", X.entity_key(F.col("phrase")))
    return keyed.groupBy("entity_key").agg(F.min_by("phrase", F.struct(-F.col("df"), F.col("phrase"))).alias("name"), F.sum("df").alias("df"), F.count(F.lit(1)).alias("n_variants"))


def mentions(docs: DataFrame, phrases: Column, vocab: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Distinct (kept columns, entity_key): documents' phrases looked up in the vocabulary."""
    keyed = vocab.select("phrase", X.entity_key(F.col("phrase")).alias("entity_key"))
    return docs.select(*keep, F.explode(F.array_distinct(phrases)).alias("phrase")).join(keyed, "phrase").select(*keep, "entity_key").distinct()


def count_cube(found: DataFrame, by: tuple[str, ...] = ("entity", "source", "year"), doc: str = "doc_id", once: bool = False) -> DataFrame:
    """(by..., df): distinct documents; found may repeat a document's entity. once: it doesn't, so that only partial counts
    are shuffled and not its rows."""
    return (found.select(*by) if once else found.select(doc, *by).distinct()).groupBy(*by).agg(F.count(F.lit(1)).alias("df"))


def denominators(docs: DataFrame) -> DataFrame:
    """(source, year, grp, n_docs) at two grains by GROUPING SETS, over all documents; grp is NULL in the coarser."""
    docs = docs.withColumn("g", F.coalesce("grp", F.lit("other")))
    return docs.groupingSets([["source", "year"], ["source", "year", "g"]], "source", "year", "g").agg(F.count(F.lit(1)).alias("n_docs")).withColumnRenamed("g", "grp")


def group_counts(found: DataFrame, known: DataFrame, years: tuple[int, int], doc: str = "doc_id") -> DataFrame:
    """(entity, grp, df) in the given years; groups that aren't in known count as "other"."""
    rows = found.where(F.col("year").between(*years)).join(known.select("grp", F.lit(True).alias("k")).distinct(), "grp", "left")
    rows = rows.withColumn("grp", F.when(F.col("k"), F.col("grp")).otherwise(F.lit("other")))
    return count_cube(rows, ("entity", "grp"), doc)


def any_source_vocabulary(counts: DataFrame, least: dict[str, int], default: int = 3) -> DataFrame:
    """Phrases (phrase, source, df) frequent enough in any one source; a source can have a threshold of its own."""
    enough = F.lit(default)
    for s, n in sorted(least.items()):
        enough = F.when(F.col("source") == s, F.lit(n)).otherwise(enough)
    return counts.groupBy("phrase").agg(F.max(F.col("df") >= enough).alias("ok"), F.sum("df").cast("long").alias("df"), F.count(F.lit(1)).alias("n_sources")).where("ok").drop("ok")
