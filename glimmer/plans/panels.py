"""Panels that give the driver's tables the shape of a dated corpus, in both engines, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators.cube import dealt
from glimmer.operators.windows import Params

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with DuckDB SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The trade panel's windows: orders from 1995 to 2001, the last year partial.
TRADE = Params(cutoff=2001, first=1995, min_volume=3, max_rate=1.0, max_spread=0.999, min_sources=1, weak_volume=20, min_spread_docs=3, min_group_docs=10, parent_docs=10, parent_age=4, min_future=3)
PAST = Params(cutoff=1997, first=1995, takeoff=1.5, min_future=3)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ids(spark: SparkSession, d: str, name: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """(id): the keys of a table, from which rule queries make their cases."""
    return table(spark, d, name).select(F.col(key).cast("long").alias("id"))


ORDER_IDS = "(SELECT o_orderkey AS id FROM orders)"


def trade_docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, year, grp): an order, its market segment, year and nation."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", F.year("o_orderdate").alias("year"))
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("source"), "c_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("grp"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("doc_id", "source", "year", "grp")


def _items(spark: SparkSession, d: str, entity: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col(entity).alias("entity"))
    return items.join(trade_docs(spark, d), "doc_id").select("doc_id", "entity", "source", "year", "grp")


def trade_found(spark: SparkSession, d: str, entity: str = "l_partkey") -> DataFrame:
    """(doc_id, entity, source, year, grp): parts of orders, each once. Lines are joined first: where that deals them by order,
    the distinct rows of an order are in one place already."""
    return _items(spark, d, entity).distinct()


def trade_names(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, entity, source, year, grp): part names of orders, each once."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.lower("p_name").alias("name"))
    return _items(spark, d, "l_partkey").join(part, "entity").select("doc_id", F.col("name").alias("entity"), "source", "year", "grp").distinct()


def trade_totals(spark: SparkSession, d: str) -> DataFrame:
    return trade_docs(spark, d).groupBy("source", "year").agg(F.count(F.lit(1)).alias("n_docs"))


TRADE_SQL = """docs AS (SELECT o_orderkey AS doc_id, c_mktsegment AS source, year(o_orderdate) AS year, n_name AS grp FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
found AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS entity, source, year, grp FROM lineitem JOIN docs ON doc_id = l_orderkey),
names AS (SELECT DISTINCT doc_id, lower(p_name) AS entity, source, year, grp FROM found JOIN part ON p_partkey = entity),
cube AS (SELECT entity, source, year, count(*) AS df FROM found GROUP BY ALL),
totals AS (SELECT source, year, count(*) AS n_docs FROM docs GROUP BY ALL),
groups AS (SELECT entity, grp, count(*) AS df FROM found WHERE year BETWEEN 1999 AND 2001 GROUP BY ALL),
sizes AS (SELECT grp, count(*) AS n_docs FROM docs WHERE year BETWEEN 1999 AND 2001 GROUP BY ALL),
own AS (SELECT entity, source, coalesce(sum(df) FILTER (year BETWEEN 1999 AND 2001), 0)::BIGINT AS d_recent, coalesce(sum(df) FILTER (year BETWEEN 1995 AND 1997), 0)::BIGINT AS d_base FROM cube GROUP BY ALL),
every AS (SELECT source, coalesce(sum(n_docs) FILTER (year BETWEEN 1999 AND 2001), 0)::BIGINT AS n_recent, coalesce(sum(n_docs) FILTER (year BETWEEN 1995 AND 1997), 0)::BIGINT AS n_base FROM totals GROUP BY ALL),
sums AS (SELECT entity, source, d_recent, d_base, n_recent, n_base FROM own JOIN every USING (source)),
yearly AS (SELECT year, sum(n_docs) AS n FROM totals GROUP BY ALL),
spine AS (SELECT e.entity, y.year::INT AS year FROM (SELECT DISTINCT entity FROM cube) e, range(1995, 2002) y(year)),
dense AS (SELECT entity, year, coalesce(sum(df), 0)::BIGINT AS docs, coalesce(sum(df), 0) / max(greatest(n, 1)) AS share FROM spine LEFT JOIN cube USING (entity, year) LEFT JOIN yearly USING (year) GROUP BY ALL)"""


def text_docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, lang, source, year): documents with a year by their id."""
    return dealt(table(spark, d, "documents").select("doc_id", "text", "lang", "source", (F.lit(2012) + F.pmod(F.floor(F.col("doc_id") / 20), F.lit(15))).cast("int").alias("year")))


TEXT_SQL = "tdocs AS (SELECT doc_id, text, lang, source, (2012 + (doc_id // 20) % 15)::INT AS year FROM documents)"
