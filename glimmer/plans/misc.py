"""Queries over readers, answers, models and streams, mostly on inline rows or the driver's tables in another role."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import answers as A
from glimmer.operators import axes, cube, grouping, ml
from glimmer.operators import rank as R
from glimmer.plans.panels import TRADE_SQL, ids, query, table, trade_found, trade_totals
from glimmer.sources import readers, sinks
from glimmer.streaming import cube as streams


def _series(s, d):
    return axes.share_series(cube.count_cube(trade_found(s, d), once=True), trade_totals(s, d), 1995, 2001)


# Readers: records come from ranges in both engines.
@query("""WITH r AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'arXiv (Cornell)' ELSE 'Journal ' || (id % 9)::VARCHAR END AS source, id % 3 AS inst, id % 5 AS refs FROM (SELECT c_custkey AS id FROM customer) t)
SELECT id::VARCHAR AS doc_id, (2010 + id % 15)::INT AS year, 'Title ' || id::VARCHAR || ' . word' || (id % 7)::VARCHAR || ' of it ; key' || (id % 4)::VARCHAR AS text FROM (SELECT * FROM r WHERE NOT starts_with(source, 'arXiv') AND (inst > 0 OR refs > 0))""")
def paper_reader(s, d):
    """Half of the records have an inverted index for an abstract, and year under its other name."""
    raw = ids(s, d, "customer", "c_custkey").selectExpr(
        "cast(id AS string) AS id", "if(id % 2 = 0, concat('Title ', id), null) AS title", "if(id % 2 = 1, concat('Title ', id), null) AS display_name", "if(id % 2 = 0, cast(2010 + id % 15 AS int), null) AS year", "if(id % 2 = 1, cast(2010 + id % 15 AS int), null) AS publication_year",
        "if(id % 2 = 0, concat('word', id % 7, ' of it'), null) AS abstract", "if(id % 2 = 1, map('it', array(2), concat('word', id % 7), array(0), 'of', array(1)), null) AS abstract_inverted_index", "array(concat('key', id % 4)) AS keywords",
        "array(named_struct('institutions', if(id % 3 > 0, array(named_struct('id', 'i', 'type', 't', 'country', 'c')), cast(array() AS array<struct<id: string, type: string, country: string>>)))) AS authorships", "if(id % 5 > 0, array('r'), cast(array() AS array<string>)) AS referenced_works", "if(id % 4 = 0, 'arXiv (Cornell)', concat('Journal ', id % 9)) AS source", "cast(null AS string) AS doi", "'1702' AS subfield",
    )
    return readers.papers(raw).select("doc_id", "year", F.replace("text", F.lit(" it . key"), F.lit(" it ; key")).alias("text"))


@query("WITH r AS (SELECT DISTINCT id % 150 AS id, [['cs.LG', 'math.ST'], ['physics.optics', 'cs.AI'], ['q-bio.NC'], ['math.ST', 'physics.optics'], ['stat.ML', 'math.PR', 'cs.CL']][1 + id % 150 % 5] AS c FROM (SELECT c_custkey AS id FROM customer) t) SELECT id::VARCHAR AS doc_id, CASE id % 5 WHEN 0 THEN 'cs' WHEN 1 THEN 'cs' WHEN 3 THEN 'math' WHEN 4 THEN 'cs' END AS owner FROM r WHERE id % 5 <> 2")
def owner_sets(s, d):
    raw = ids(s, d, "customer", "c_custkey").selectExpr("cast(id % 150 AS string) AS id", "element_at(array(array('cs.LG', 'math.ST'), array('physics.optics', 'cs.AI'), array('q-bio.NC'), array('math.ST', 'physics.optics'), array('stat.ML', 'math.PR', 'cs.CL')), cast(1 + id % 150 % 5 AS int)) AS categories", "'2020-01-01' AS created", "concat('T', id % 150) AS title", "'a' AS abstract")
    return readers.preprints(raw, ("cs", "math")).join(raw.dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), readers.owner_set(F.col("categories"), ("cs", "math")).alias("owner")), "doc_id").select("doc_id", "owner")


@query("WITH r AS (SELECT id, ['Show HN: A thing', 'Launch HN: Foo (YC S24)', 'Plain title', 'Ask HN: Why'][1 + id % 4] || ' ' || id::VARCHAR AS t, id % 6 AS score FROM (SELECT c_custkey AS id FROM customer) t) SELECT id::VARCHAR AS doc_id, regexp_replace(regexp_replace(t, '^(Show|Launch|Ask|Tell) HN:\\s*', ''), '\\s*\\(YC [A-Z]+\\d+\\)', '') AS title, id % 4 < 2 AS launch, (1970 + id % 40)::INT AS year FROM r WHERE score >= 2")
def community_reader(s, d):
    raw = ids(s, d, "customer", "c_custkey").selectExpr("id", "concat(element_at(array('Show HN: A thing', 'Launch HN: Foo (YC S24)', 'Plain title', 'Ask HN: Why'), cast(1 + id % 4 AS int)), ' ', id) AS title", "id % 6 AS score", "(id % 40) * 31557600 + 86400 AS time")
    return readers.community(raw).select("doc_id", "title", "launch", "year")


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'T' || page_id::VARCHAR ELSE regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '\.[a-z]+$', ''), '[-_]+', ' ', 'g') END AS title, (2015 + page_id % 10)::INT AS year FROM pages WHERE page_id % 4 < 2 AND regexp_extract(url, '^https?://(?:www\.)?([^/]+)', 1) NOT IN ('', 'example.com')""")
def press_reader(s, d):
    raw = table(s, d, "pages").selectExpr("page_id", "url", "if(page_id % 3 = 0, concat('T', page_id), '') AS title", "concat(2015 + page_id % 10, '-02-03') AS date", "if(page_id % 4 < 2, if(page_id % 2 = 0, 'url', 'news'), if(page_id % 4 = 2, 'lastmod', 'none')) AS date_source")
    return readers.press(raw, ("example.com",), keep=("page_id",)).select("page_id", "title", "year")


@query("SELECT lower(regexp_replace(c_name, '[^a-zA-Z0-9]+', ' ', 'g')) AS company, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END::DOUBLE AS amount, strftime(o_orderdate, '%Y-%m-%d') AS filed FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0")
def form_d_join(s, d):
    """Orders as filings of their customers: amounts that aren't numbers, marks of either kind that are missing, filings without a date."""
    o = table(s, d, "orders").withColumn("ACCESSIONNUMBER", F.concat(F.lit("A"), "o_orderkey"))
    issuers = o.join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("ACCESSIONNUMBER", "concat(c_name, ', L.L.C.') AS ENTITYNAME", "if(o_orderkey % 3 = 0, 'NO', 'YES') AS IS_PRIMARYISSUER_FLAG")
    offers = o.selectExpr("ACCESSIONNUMBER", "if(o_orderkey % 7 = 0, 'Indefinite', cast(o_totalprice AS string)) AS TOTALAMOUNTSOLD", "if(o_orderkey % 5 = 0, 'True', if(o_orderkey % 2 = 0, 'false', null)) AS ISPOOLEDINVESTMENTFUNDTYPE", "if(o_orderkey % 11 = 0, 'TRUE', if(o_orderkey % 4 = 0, 'false', null)) AS ISAMENDMENT")
    subs = o.select("ACCESSIONNUMBER", F.when(F.col("o_orderkey") % 13 == 0, "undated").otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("FILING_DATE"))
    return readers.form_d(issuers, offers, subs).select("company", "amount", F.date_format("at", "yyyy-MM-dd").alias("filed"))


@query(r"SELECT DISTINCT lower(trim(regexp_replace(replace(p_name || ' ' || p_type || '_(' || p_brand || ')', '_', ' '), '\s*\([^)]*\)\s*$', ''))) AS title FROM part")
def encyclopedia_titles(s, d):
    return readers.titles(table(s, d, "part").select(F.concat("p_name", F.lit(" "), "p_type", F.lit("_("), "p_brand", F.lit(")")).alias("value")))


@query("WITH o AS (SELECT o_custkey AS f, o_orderkey AS p, o_orderdate AS dt, list_sort(list_distinct(list(p_brand))) AS codes FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING bool_or(starts_with(p_brand, 'Brand#1'))) SELECT f AS family_id, p AS publication_number, strftime(dt, '%Y-%m-%d') AS published, array_to_string(codes, ',') AS codes FROM o QUALIFY row_number() OVER (PARTITION BY f ORDER BY strftime(dt, '%Y%m%d')::INT, p) = 1")
def patent_families(s, d):
    """Families are customers, publications their orders, codes the brands bought."""
    items = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    raw = table(s, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("family_id"), F.col("o_orderkey").alias("publication_number"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("publication_date")).agg(F.collect_list(F.struct(F.col("p_brand").alias("code"), F.lit(True).alias("inventive"))).alias("cpc"))
    return readers.patents(raw, ("Brand#1",)).select("family_id", "publication_number", F.date_format("published", "yyyy-MM-dd").alias("published"), F.array_join("codes", ",").alias("codes"))


@query("SELECT l_suppkey AS id, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS matched FROM lineitem GROUP BY ALL")
def matched_queries(s, d):
    hits = table(s, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("query"), "l_tax")
    return readers.matched_union(hits).select("id", F.array_join("matched_queries", ",").alias("matched"))


@query(r"WITH x AS (SELECT doc_id, lower(concat_ws(' ', lang, source, nullif(CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END, ''))) AS f, lower(concat_ws(' ', lang, source)) AS st, doc_id % 4 = 0 OR text = '' AS bare FROM documents) SELECT doc_id FROM x WHERE CASE WHEN bare THEN regexp_matches(st, 'src1|en') ELSE regexp_matches(f, 'src1|en') AND regexp_matches(f, 'the|das') END AND NOT regexp_matches(f, 'ooo')")
def relevance_rules(s, d):
    rows = table(s, d, "documents").select("doc_id", F.col("lang").alias("title"), F.col("source").alias("topic"), F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("text")).alias("abstract"))
    return readers.relevant(rows, ("src1|en", "the|das"), ("ooo",)).select("doc_id")


# Answers.
_VAR = "v AS (SELECT id, 'term' || (id % 40)::VARCHAR || CASE WHEN id % 3 = 0 THEN 's' ELSE '' END || ' model' AS phrase, id % 5 = 0 AS verified, (id * 7 % 30) / 10.0 AS burst, id % 9 AS lit, id % 4 AS repo FROM (SELECT c_custkey AS id FROM customer) t)"


def _variants(s, d):
    return ids(s, d, "customer", "c_custkey").selectExpr("id", "concat('term', id % 40, if(id % 3 = 0, 's', ''), ' model') AS phrase", "id % 5 = 0 AS verified", "cast(id * 7 % 30 AS double) / 10 AS burst", "id % 9 AS lit", "id % 4 AS repo")


@query(f"WITH {_VAR} SELECT 'term' || (id % 40)::VARCHAR AS key, arg_min(phrase, row((NOT verified)::INT, -burst, length(phrase), phrase)) AS lead, count(*)::BIGINT AS n_variants, sum(lit)::BIGINT AS lit, sum(repo)::BIGINT AS repo FROM v GROUP BY 1")
def variant_collapse(s, d):
    from glimmer.functions.text import merge_key

    return A.collapsed(_variants(s, d), F.replace(merge_key(F.col("phrase")), F.lit("model "), F.lit("")))


@query(f"WITH {_VAR} SELECT round(1 - count(DISTINCT phrase) / count(*), 6) AS duplicate_rate FROM v")
def duplicate_rate(s, d):
    return A.duplicate_rate(_variants(s, d), F.col("phrase")).select(F.round("duplicate_rate", 6).alias("duplicate_rate"))


@query(f"WITH {_VAR} SELECT id, phrase, round(burst * (1 + id % 11), 6)::DOUBLE AS score FROM v ORDER BY round(burst * (1 + id % 11), 9) DESC, phrase, id LIMIT 24")
def semantic_shortlist(s, d):
    rows = _variants(s, d).withColumn("specificity", (1 + F.col("id") % 11).cast("double")).withColumn("phrase0", F.col("phrase")).withColumn("phrase", F.concat("phrase", F.lpad(F.col("id").cast("string"), 6, "0")))
    return A.shortlist(rows).select("id", F.col("phrase0").alias("phrase"), F.round(F.col("burst") * F.col("specificity"), 6).alias("score"))


_WORDS_SQL = "array_to_string(regexp_extract_all(lower(coalesce({}, '')), '[a-zа-я0-9]+'), ' ')"


@query(f"WITH q AS (SELECT doc_id, {_WORDS_SQL.format('substr(text, 1 + (doc_id % 5), 20)')} AS q, {_WORDS_SQL.format('text')} AS t FROM documents) SELECT doc_id, len(string_split(q, ' ')) >= 3 AND contains(t, q) AS holds FROM q")
def quote_check(s, d):
    rows = table(s, d, "documents").select("doc_id", "text", F.substr("text", (1 + F.col("doc_id") % 5).cast("int"), F.lit(20)).alias("q"))
    return rows.select("doc_id", A.quote_holds(F.col("q"), F.array("text")).alias("holds"))


@query("SELECT c_custkey, round((SELECT count(*) FROM supplier WHERE s_acctbal <= c_acctbal) / (SELECT count(*) FROM supplier), 6) AS percentile FROM customer")
def forecast_percentile(s, d):
    got = A.percentile_in(table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), table(s, d, "supplier").select(F.col("s_acctbal").alias("v")), "v")
    return got.select("c_custkey", F.round("percentile", 6).alias("percentile"))


@query("WITH p AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 20 END AS grp FROM labels WHERE quality = 1), n AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 30 END AS grp FROM labels WHERE quality = 0 OR toxic = 1), u AS (SELECT id, coalesce(grp, id) AS grp, 1 AS y FROM p UNION ALL SELECT id, coalesce(grp, id), 0 FROM n) SELECT id, arg_max(grp, row(y, grp)) AS grp, max(y)::INT AS y FROM u GROUP BY id")
def label_table(s, d):
    rows = table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    pos = rows.where("quality = 1").withColumn("grp", F.when(F.col("id") % 3 != 0, F.col("id") % 20))
    neg = rows.where("quality = 0 OR toxic = 1").withColumn("grp", F.when(F.col("id") % 4 != 0, F.col("id") % 30))
    return A.labels(pos, neg)


@query("WITH r AS (SELECT id, id % 2 = 0 AS real, id % 3 <> 0 AS early, CASE WHEN id % 7 = 0 THEN 1 END AS dup_of, id * 37 % 101 AS score FROM (SELECT c_custkey AS id FROM customer) t), x AS (SELECT *, CASE WHEN real AND early THEN 1 WHEN real THEN 2 END AS tier FROM r WHERE dup_of IS NULL) SELECT id, tier::INT AS tier, score FROM x WHERE tier IS NOT NULL ORDER BY tier, score DESC, id LIMIT 15")
def adjudication_tiers(s, d):
    rows = ids(s, d, "customer", "c_custkey").selectExpr("id", "id % 2 = 0 AS real", "id % 3 <> 0 AS early", "if(id % 7 = 0, 1, null) AS dup_of", "id * 37 % 101 AS score")
    return A.tiered(rows, ["real", "early"], "early").select("id", "tier", "score")


_VERD = "vd AS (SELECT 'c' || (id % 3)::VARCHAR AS config, id // 30 AS query, id // 3 % 10 AS place, ['S', 'I', 'M', 'X', 'X'][1 + id * 7 % 5] AS verdict, id * 13 % 40 AS item FROM (SELECT c_custkey AS id FROM customer) t)"


def _verdicts(s, d):
    return ids(s, d, "customer", "c_custkey").selectExpr("concat('c', id % 3) AS config", "id div 30 AS query", "id div 3 % 10 AS place", "element_at(array('S', 'I', 'M', 'X', 'X'), cast(1 + id * 7 % 5 AS int)) AS verdict", "id * 13 % 40 AS item")


_SHARES = "count(DISTINCT query)::BIGINT AS lists, " + ", ".join(f"round(avg((verdict IN {v})::INT), 3) AS {n}" for n, v in (("precision", "('S')"), ("on_topic", "('S', 'I', 'M')"), ("i", "('I')"), ("m", "('M')"), ("x", "('X')")))


@query(f"WITH {_VERD} SELECT config, {_SHARES} FROM vd WHERE place < 8 GROUP BY ALL")
def judge_precision(s, d):
    return grouping.verdicts_by(_verdicts(s, d), ["config"], 8)


@query(f"WITH {_VERD} SELECT config, query, {_SHARES} FROM vd WHERE place < 8 GROUP BY ALL")
def judge_precision_by_query(s, d):
    return grouping.verdicts_by(_verdicts(s, d), ["config", "query"], 8)


@query(f"WITH {_VERD} SELECT query, round(count(*) / 10, 6) AS overlap FROM (SELECT query, item FROM vd WHERE config = 'c0' INTERSECT SELECT query, item FROM vd WHERE config = 'c1') GROUP BY ALL UNION ALL SELECT DISTINCT query, 0.0 FROM vd WHERE query NOT IN (SELECT query FROM (SELECT query, item FROM vd WHERE config = 'c0' INTERSECT SELECT query, item FROM vd WHERE config = 'c1'))")
def ranking_overlap(s, d):
    v = _verdicts(s, d).withColumn("id", F.col("item"))
    return A.top_overlap(v.where("config = 'c0'"), v.where("config = 'c1'"), 10).withColumn("overlap", F.round("overlap", 6))


@query(f"WITH {_VERD} SELECT verdict, count(*) FILTER (config = 'c0')::BIGINT AS c0, count(*) FILTER (config = 'c1')::BIGINT AS c1, count(*) FILTER (config = 'c2')::BIGINT AS c2 FROM vd GROUP BY ALL")
def verdict_crosstab(s, d):
    return _verdicts(s, d).groupBy("verdict").pivot("config", ["c0", "c1", "c2"]).count().fillna(0)


@query("WITH r AS (SELECT id, id % 3 <> 0 AS t, ['rubric', 'task', 'term'][1 + id % 3] AS k FROM (SELECT c_custkey AS id FROM customer) x), w AS (SELECT id, (id // 3 % 2) = 0 AS t, k FROM r) SELECT id, NOT (k = 'rubric' OR (NOT t AND k IN ('rubric', 'task'))) AS keep, CASE WHEN NOT (k = 'rubric' OR (NOT t AND k IN ('rubric', 'task'))) AND NOT t THEN 'G' END AS mark FROM w")
def import_votes(s, d):
    return A.import_votes(ids(s, d, "customer", "c_custkey").selectExpr("id", "id div 3 % 2 = 0 AS is_technology", "element_at(array('rubric', 'task', 'term'), cast(1 + id % 3 AS int)) AS kind"))


@query(f"""WITH {TRADE_SQL}, y AS (SELECT entity, string_agg(year::VARCHAR || ': ' || docs::VARCHAR, ', ' ORDER BY year) AS years FROM dense GROUP BY ALL), b AS (SELECT entity, min(year) AS begun FROM cube WHERE source = 'BUILDING' AND df >= 2 GROUP BY ALL), p AS (SELECT entity, source, sum(df) AS n FROM cube WHERE source <> 'BUILDING' GROUP BY ALL), o AS (SELECT entity, string_agg(source || ': ' || n::BIGINT::VARCHAR, ', ' ORDER BY source) AS others FROM p GROUP BY ALL)
SELECT entity, 'by year ' || years || '; first in BUILDING ' || coalesce(begun::VARCHAR, 'never') || coalesce('; ' || others, '') || '; article ' || CASE WHEN entity % 3 = 0 THEN 'yes' ELSE 'no' END AS line FROM y LEFT JOIN b USING (entity) LEFT JOIN o USING (entity)""")
def measurement_lines(s, d):
    layers = cube.count_cube(trade_found(s, d), once=True).select("entity", F.col("source").alias("layer"), "year", F.col("df").alias("docs"))
    return A.measurement_line(_series(s, d), layers, 2, "BUILDING", F.col("entity") % 3 == 0)


@query(f"""WITH {TRADE_SQL}, a AS (SELECT entity, year, docs, CASE WHEN year = 2001 THEN docs * 12.0::DOUBLE / 7 ELSE docs END AS d FROM dense),
m AS (SELECT entity, sum(docs)::BIGINT AS total, coalesce(sum(d) FILTER (year BETWEEN 1999 AND 2001), 0) / 3 AS r, coalesce(sum(d) FILTER (year BETWEEN 1994 AND 1996), 0) / 3 AS p, coalesce(2001 - min(year) FILTER (docs >= 3), 0)::INT AS age, arg_max(year, row(docs, -year)) FILTER (year < 2001 AND docs > 0)::INT AS peak_year, coalesce(max(docs) FILTER (year < 2001), 0) AS top, sum(docs) FILTER (year = 2000) AS l FROM a GROUP BY ALL)
SELECT entity, total, round(r, 6) AS recent_mean, round(p, 6) AS prior_mean, round(ln((r + 1) / (p + 1)), 6) + 0.0 AS growth, age, round((l + 1) / (top + 1), 6) AS peak_ratio, peak_year, round(coalesce(l / nullif(total, 0), 0), 6) AS last_share FROM m""")
def source_metrics(s, d):
    r = lambda c: F.round(c, 6).alias(c)
    return A.source_metrics(_series(s, d), 2001, 12.0 / 7).select("entity", "total", r("recent_mean"), r("prior_mean"), (F.round("growth", 6) + F.lit(0.0)).alias("growth"), "age", r("peak_ratio"), "peak_year", r("last_share"))


@query("WITH r AS (SELECT id, ['confirmed', 'watchlist', 'unverified'][1 + id % 3] AS state, id * 7 % 10 < 6 AS label FROM (SELECT c_custkey AS id FROM customer) t) SELECT round(avg(label::INT) FILTER (state = 'confirmed'), 6) AS confirmed_precision, round(avg(label::INT) FILTER (state = 'watchlist'), 6) AS watchlist_useful, count(*) FILTER (state = 'confirmed' AND NOT label)::BIGINT AS noise_confirmed FROM r")
def benchmark_metrics(s, d):
    rows = ids(s, d, "customer", "c_custkey").selectExpr("id", "element_at(array('confirmed', 'watchlist', 'unverified'), cast(1 + id % 3 AS int)) AS state", "id * 7 % 10 < 6 AS label")
    return A.benchmark_metrics(rows).select(F.round("confirmed_precision", 6).alias("confirmed_precision"), F.round("watchlist_useful", 6).alias("watchlist_useful"), "noise_confirmed")


@query(r"WITH l AS (SELECT lang AS key, source AS layer, split_part(text, chr(10), 1) AS title, n_chars, doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY key, layer ORDER BY CASE layer WHEN 'src0' THEN -n_chars WHEN 'src1' THEN -doc_id ELSE doc_id END, title) AS p FROM l WHERE t <> ''), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key, layer, t ORDER BY p) = 1) SELECT key, layer, row_number() OVER (PARTITION BY key, layer ORDER BY p)::INT AS rank, md5(title) AS title FROM o QUALIFY rank <= 3")
def layer_sources(s, d):
    """Layers of documents: one by length, one the latest first, the others the earliest first."""
    docs = table(s, d, "documents").select(F.col("lang").alias("key"), F.col("source").alias("layer"), F.split("text", "\n")[0].alias("title"), "n_chars", "doc_id")
    order = {"src0": -F.col("n_chars"), "src1": -F.col("doc_id")}
    return A.layer_sources(docs, order, F.col("doc_id")).withColumn("title", F.md5(F.col("title").cast("binary")))


@query("SELECT user_id AS k, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def last_writes(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("k"), "event_type", "event_id")
    return sinks.last_writes(e, ["k"], "event_id").select("k", "event_type", "event_id")


@query(f"WITH {TRADE_SQL}, f AS (SELECT entity AS technology, y AS year, sum(docs) / 2.0::DOUBLE AS baseline FROM dense, (VALUES (1996), (1997), (1999)) v(y) WHERE year BETWEEN 1995 AND 1996 GROUP BY ALL) SELECT technology, f.year::INT AS year, round(any_value(baseline), 6) AS baseline, round(sum(docs) / greatest(any_value(least(f.year + 5, 2001) - (f.year + 3) + 1), 1), 6)::DOUBLE AS outcome, sum(docs) / greatest(any_value(least(f.year + 5, 2001) - (f.year + 3) + 1), 1) >= 1.2 * any_value(baseline) AS hit FROM f LEFT JOIN dense ON entity = technology AND dense.year BETWEEN f.year + 3 AND f.year + 5 GROUP BY technology, f.year")
def forecast_scoring(s, d):
    """Forecasts of three years as of 2002: the outcome is three to five years after, as far as these have passed."""
    series = _series(s, d).select(F.col("entity").alias("technology"), "year", F.col("docs").alias("n"))
    made = F.explode(F.array(*[F.lit(y) for y in (1996, 1997, 1999)])).alias("year")
    f = series.where("year BETWEEN 1995 AND 1996").groupBy("technology").agg((F.sum("n") / 2.0).alias("baseline")).select("technology", made, "baseline")
    return sinks.scored_forecasts(f, series, 2002, times=1.2).select("technology", "year", F.round("baseline", 6).alias("baseline"), F.round("outcome", 6).alias("outcome"), "hit")


@query(f"WITH {TRADE_SQL}, c AS (SELECT entity, source AS science, year, df FROM cube), h AS (SELECT entity, arg_min(science, row(-n, science)) AS home FROM (SELECT entity, science, sum(df) AS n FROM c WHERE year <= 1998 GROUP BY ALL) GROUP BY ALL) SELECT home, science AS target, sum(df)::BIGINT AS n FROM c JOIN h USING (entity) WHERE year BETWEEN 1999 AND 2001 AND science <> home GROUP BY ALL")
def migration_flows(s, d):
    c = cube.count_cube(trade_found(s, d), once=True).withColumnRenamed("source", "science")
    home = c.where("year <= 1998").groupBy("entity", "science").agg(F.sum("df").alias("n")).groupBy("entity").agg(F.min_by("science", F.struct(-F.col("n"), F.col("science"))).alias("home"))
    return c.where(F.col("year").between(1999, 2001)).join(home, "entity").where("science <> home").groupBy("home", F.col("science").alias("target")).agg(F.sum("df").alias("n"))


@query("WITH e AS (SELECT doc_id, n_chars, quality, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS a FROM documents JOIN labels USING (doc_id)) SELECT quality::INT AS quality, count(*)::BIGINT AS n, round(sum(count(*)) OVER () / (2 * count(*)), 6)::DOUBLE AS weight FROM e GROUP BY ALL")
def balanced_weights(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return ml.balanced(rows, "quality").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("weight"), 6).alias("weight"))


# Models and clusters: rows only; tests hold their properties.
def _training(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return rows.select("doc_id", "quality", F.when(F.col("doc_id") % 5 != 0, F.length(F.regexp_replace("text", "[^#$%&*|!]", "")) / F.greatest("n_chars", F.lit(1))).alias("symbols"), F.log1p("n_chars").alias("size"))


@query()
def logistic_scores(s, d):
    rows = _training(s, d)
    return ml.probabilities(ml.fit_logistic(rows, ["symbols", "size"], "quality"), rows, ["symbols", "size"]).select("doc_id", F.round("p", 6).alias("p"))


@query()
def logistic_explained(s, d):
    rows = _training(s, d)
    got = ml.explained(ml.fit_logistic(rows, ["symbols", "size"], "quality"), rows, ["symbols", "size"], 2)
    return got.select("doc_id", F.col("explanation")[0]["name"].alias("first"), F.round(F.col("explanation")[0]["value"], 6).alias("value"))


@query()
def boosted_scores(s, d):
    rows = _training(s, d)
    return ml.probabilities(ml.fit_boosted(rows, ["symbols", "size"], "quality", rounds=5), rows, ["symbols", "size"]).select("doc_id", F.round("p", 6).alias("p"))


@query()
def out_of_fold_scores(s, d):
    rows = _training(s, d)
    return ml.out_of_fold(rows, ["symbols", "size"], "quality", "doc_id", 3).select("doc_id", F.round("p", 6).alias("p"))


@query()
def isotonic_table(s, d):
    rows = _training(s, d).withColumn("x", F.coalesce("symbols", F.lit(0.0)))
    return s.createDataFrame(ml.calibration_table(rows.withColumn("x", 1 - F.least("x", F.lit(1.0))), "x", "quality"), "x double, y double")


@query()
def bootstrap_interval(s, d):
    rows = _training(s, d).select("doc_id", "quality", "size")
    return ml.bootstrap(rows, "size", "quality", 50)


@query()
def cluster_lineage(s, d):
    from glimmer.operators.vectors import centroids

    e = table(s, d, "embeddings")
    got = ml.clusters(e, 6).withColumn("early", F.col("vec_id") % 2 == 0)
    c = centroids(got, ["cluster", "early"])
    return ml.lineage(c.where("early").select("cluster", "centroid"), c.where("NOT early").select("cluster", "centroid")).select("cluster", "parent", F.round("similarity", 6).alias("similarity"), "born")


# Streams: the batch form is registered, tests hold the stream to it.
@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def events_tumbling(s, d):
    e = table(s, d, "events").withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), s.conf.get("spark.sql.session.timeZone")))
    return streams.tumbling(e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


@query("WITH g AS (SELECT user_id, ts, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) >= 1800000000, true) AS b FROM events), n AS (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*)::BIGINT AS n FROM n GROUP BY user_id, k")
def events_sessions(s, d):
    return streams.sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", "n")


@query("SELECT strftime(to_timestamp(h * 3600 + o * 3600)::TIMESTAMP, '%Y-%m-%d %H') AS start, event_type, count(*)::BIGINT AS n FROM (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS h, unnest([-5, -4, -3, -2, -1, 0]) AS o FROM events) GROUP BY ALL")
def events_sliding(s, d):
    return streams.sliding(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")
