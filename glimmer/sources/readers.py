"""Readers of corpora. Each takes a raw DataFrame (so that any Spark source serves) and returns documents.

Paths with Hive-style folders (subfield=*/year=*) are read by raw_json, whose partition columns prune files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.functions.text import company_name, rebuilt_abstract

DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("grp", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("doi", T.StringType())])

PAPER = (
    "id string, title string, display_name string, year int, publication_year int, abstract string, abstract_inverted_index map<string, array<int>>, "
    "keywords array<string>, authorships array<struct<institutions: array<struct<id: string, type: string, country: string>>>>, referenced_works array<string>, source string, doi string, subfield string"
)


def raw_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON, gzip or not, under Hive-style folders; truncated files end silently, broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "false").json(path)


def with_optional(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that are missing, with their defaults."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def has_origin(authorships: Column, references: Column) -> Column:
    """Someone's institution or at least one reference is known."""
    return F.exists(F.coalesce(authorships, F.expr("cast(array() as array<struct<institutions: array<struct<id: string, type: string, country: string>>>>)")), lambda a: F.size(F.coalesce(a["institutions"], F.expr("cast(array() as array<struct<id: string, type: string, country: string>>)"))) > 0) | (F.size(F.coalesce(references, F.expr("cast(array() as array<string>)"))) > 0)


def papers(raw: DataFrame) -> DataFrame:
    """Both shapes of paper records; preprint copies and self-publications go. Title, abstract and keywords make the text."""
    none = lambda kind: F.lit(None).cast(kind)
    raw = with_optional(raw, {f.name: none(f.dataType) for f in T.StructType.fromDDL(PAPER).fields})
    title = F.coalesce("title", "display_name", F.lit(""))
    abstract = F.coalesce(F.col("abstract"), rebuilt_abstract(F.col("abstract_inverted_index")), F.lit(""))
    keywords = F.concat_ws(" ; ", F.col("keywords"))
    text = F.concat_ws(" . ", *[F.when(c != "", c) for c in (title, abstract, keywords)])
    kept = raw.where(~F.coalesce(F.col("source"), F.lit("")).startswith("arXiv")).where(has_origin(F.col("authorships"), F.col("referenced_works")))
    return kept.select(F.col("id").alias("doc_id"), F.lit("openalex").alias("source"), F.coalesce("year", "publication_year").alias("year"), F.concat(F.lit("oa:"), "subfield").alias("grp"), title.alias("title"), text.alias("text"), "doi")


def owner_set(categories: Column, sets: tuple[str, ...]) -> Column:
    """The primary category's archive if configured, else the first configured one by priority, else NULL."""
    archives = F.transform(categories, lambda c: F.substring_index(c, ".", 1))
    return F.when(archives[0].isin(*sets), archives[0]).otherwise(F.get(F.filter(F.array(*[F.lit(x) for x in sets]), lambda x: F.array_contains(archives, x)), F.lit(0)))


def preprints(raw: DataFrame, sets: tuple[str, ...]) -> DataFrame:
    """(id, categories, created, title, abstract): each id once, in its owner's set."""
    rows = raw.withColumn("owner", owner_set(F.col("categories"), sets)).where(F.col("owner").isNotNull()).dropDuplicates(["id"])
    return rows.select(F.col("id").alias("doc_id"), F.lit("arxiv").alias("source"), F.substring("created", 1, 4).cast("int").alias("year"), F.concat(F.lit("ax:"), F.col("categories")[0]).alias("grp"), "title", F.concat_ws(" . ", "title", "abstract").alias("text"), F.lit(None).cast("string").alias("doi"))


def daily_papers(raw: DataFrame) -> DataFrame:
    """(arxiv_id, date, title, summary, ai_keywords): keywords join the title, so that they enter the vocabulary."""
    title = F.concat_ws(" . ", "title", F.concat_ws(" ; ", "ai_keywords"))
    return raw.select(F.col("arxiv_id").alias("doc_id"), F.lit("hf").alias("source"), F.substring("date", 1, 4).cast("int").alias("year"), F.lit(None).cast("string").alias("grp"), title.alias("title"), F.concat_ws(" . ", title, "summary").alias("text"), F.lit(None).cast("string").alias("doi"))


def community(raw: DataFrame, least: int = 2) -> DataFrame:
    """(id, title, score, time): prefix and batch mark stripped, launches flagged, low scores dropped."""
    prefix = r"^(Show|Launch|Ask|Tell) HN:\s*"
    title = F.regexp_replace(F.regexp_replace("title", prefix, ""), r"\s*\(YC [A-Z]+\d+\)", "")
    return raw.where(F.col("score") >= least).select(F.col("id").cast("string").alias("doc_id"), F.lit("hn").alias("source"), F.year(F.timestamp_seconds("time")).alias("year"), title.alias("title"), F.col("title").rlike(r"^(Show|Launch) HN:").alias("launch"))


def startups(raw: DataFrame) -> DataFrame:
    """(name, batch, one_liner, long_description, tags): the year is the batch's."""
    return raw.select(F.col("name").alias("doc_id"), F.lit("yc").alias("source"), F.nullif(F.regexp_extract("batch", r"(20\d\d)", 1), F.lit("")).cast("int").alias("year"), F.col("one_liner").alias("title"), F.concat_ws(" . ", "one_liner", "long_description", F.concat_ws(" ", "tags")).alias("text"))


def press(raw: DataFrame, blocked: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, title, date, date_source): dates from the URL or a news map only; the URL's last part serves for a title.
    A row each, whether or not its URL is another's too, with the columns `keep` (URLs are no keys to join by)."""
    slug = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.regexp_replace("url", r"/+\z", ""), "/"), -1), r"\.[a-z]+\z", ""), "[-_]+", " ")
    host = F.regexp_extract("url", r"^https?://(?:www\.)?([^/]+)", 1)
    return raw.where(F.col("date_source").isin("url", "news") & ~host.isin(*blocked, "")).select(F.col("url").alias("doc_id"), F.lit("press").alias("source"), F.substring("date", 1, 4).cast("int").alias("year"), F.coalesce(F.nullif("title", F.lit("")), slug).alias("title"), host.alias("grp"), *keep)


def form_d(issuers: DataFrame, offerings: DataFrame, submissions: DataFrame) -> DataFrame:
    """Three tables by ACCESSIONNUMBER: primary issuers' filings that have a date, without amendments and pooled funds (a mark
    that is missing is no mark); amounts that aren't numbers are 0."""
    marked = lambda c: F.coalesce(F.lower(c) == "true", F.lit(False))
    kept = offerings.where(~marked(F.col("ISAMENDMENT")) & ~marked(F.col("ISPOOLEDINVESTMENTFUNDTYPE")))
    rows = issuers.where("IS_PRIMARYISSUER_FLAG = 'YES'").join(kept, "ACCESSIONNUMBER").join(submissions, "ACCESSIONNUMBER")
    return rows.where(F.try_to_timestamp("FILING_DATE", F.lit("dd-MMM-yyyy")).isNotNull()).select(company_name(F.col("ENTITYNAME")).alias("company"), F.coalesce(F.col("TOTALAMOUNTSOLD").try_cast("double"), F.lit(0.0)).alias("amount"), F.try_to_timestamp("FILING_DATE", F.lit("dd-MMM-yyyy")).cast("date").alias("at"))


def titles(raw: DataFrame) -> DataFrame:
    """Lines of an encyclopedia's title list (column value): the header goes, underscores are spaces, a trailing
    parenthesis is dropped, lower case, each once."""
    t = F.lower(F.trim(F.regexp_replace(F.replace("value", F.lit("_"), F.lit(" ")), r"\s*\([^)]*\)\s*$", "")))
    return raw.where("value <> 'page_title'").select(t.alias("title")).where("title <> ''").distinct()


def patents(raw: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """(family_id, publication_number, publication_date int, cpc array<struct<code, inventive>>): the earliest publication
    of each family that has one of the code prefixes; its distinct codes."""
    has = F.exists("cpc", lambda c: F.lit(False) if not codes else F.array_contains(F.array(*[c["code"].startswith(p) for p in codes]), F.lit(True)))
    first = F.row_number().over(W.partitionBy("family_id").orderBy("publication_date", "publication_number"))
    return raw.where(has).withColumn("k", first).where("k = 1").select("family_id", "publication_number", F.to_date(F.col("publication_date").cast("string"), "yyyyMMdd").alias("published"), F.array_sort(F.array_distinct(F.transform("cpc", lambda c: c["code"]))).alias("codes"))


def projects_zip(spark: SparkSession, path: str) -> DataFrame:
    """(file, body): members of zip archives that end in .json, read on the executors."""
    import io
    import zipfile

    def opened(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.endswith(".json"):
                            yield pd.DataFrame({"file": [f"{name}!{member}"], "body": [z.read(member).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(opened, "file string, body string")


def matched_union(hits: DataFrame) -> DataFrame:
    """Records of several queries (id, query, ...) as one per id, with the queries that found it."""
    rest = [c for c in hits.columns if c not in ("id", "query")]
    return hits.groupBy("id").agg(*[F.min_by(c, "query").alias(c) for c in rest], F.array_sort(F.collect_set("query")).alias("matched_queries"))


def relevant(docs: DataFrame, all_of: tuple[str, ...], none_of: tuple[str, ...] = ()) -> DataFrame:
    """Documents (title, topic, abstract) that match every pattern and none of the others; without an abstract only the
    first pattern is asked, of title and topic."""
    full = F.lower(F.concat_ws(" ", "title", "topic", "abstract"))
    short = F.lower(F.concat_ws(" ", "title", "topic"))
    bare = F.coalesce(F.col("abstract"), F.lit("")) == ""
    every, no = F.lit(True), F.lit(True)
    for p in all_of:
        every = every & full.rlike(p)
    for p in none_of:
        no = no & ~full.rlike(p)
    return docs.where(F.when(bare, short.rlike(all_of[0])).otherwise(every) & no)
