"""Queries over a topic's pools and orders, judged lines, documents of candidates, shares of sources, ladders of cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import answers, axes, base, claims, cube, pools
from glimmer.operators import evidence as E
from glimmer.plans.later import _STEM3
from glimmer.plans.panels import TRADE_SQL, query, table, trade_found, trade_totals
from glimmer.sources import sinks

# Customers of a market segment are an area's candidates; balances and keys are their scores.
_CAND = "cand AS (SELECT c_mktsegment AS area, c_custkey AS key, CASE WHEN c_custkey % 17 > 0 THEN c_acctbal END::DOUBLE AS semantic, c_custkey * 37 % 101 / 101.0::DOUBLE AS share, c_custkey * 53 % 997 / 997.0::DOUBLE AS learned, c_custkey * 71 % 499 / 499.0::DOUBLE AS hand, c_custkey % 5 = 0 AS tagged FROM customer)"
_PCT = lambda v: f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY area, {v} IS NULL ORDER BY {v}) + (count(*) OVER (PARTITION BY area, {v}) - 1) / 2) / count(*) OVER (PARTITION BY area, {v} IS NULL) END"
_TOP = lambda source, by, k, name: f"SELECT *, '{name}' AS method, row_number() OVER (PARTITION BY area ORDER BY round({by}, 9) DESC NULLS LAST, key)::INT AS pos FROM {source} QUALIFY pos <= {k}"
_POOLED = lambda source: f"SELECT *, pool_pct * rel_pct AS blend FROM (SELECT * EXCLUDE (method, pos), {_PCT('learned')} AS pool_pct, {_PCT('relevance')} AS rel_pct FROM ({source}))"
_SHOWN = "area, method, pos, key, round(relevance, 6) AS relevance, round(learned, 6) AS learned, round(pool_pct, 6) AS pool_pct"


def _candidates(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        F.col("c_mktsegment").alias("area"), k.alias("key"), F.when(k % 17 > 0, F.col("c_acctbal").cast("double")).alias("semantic"), (k * 37 % 101 / 101.0).alias("share"),
        (k * 53 % 997 / 997.0).alias("learned"), (k * 71 % 499 / 499.0).alias("hand"), (k % 5 == 0).alias("tagged"),
    )


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("relevance", "learned", "pool_pct")})


@query(f"""WITH {_CAND}, r AS (SELECT *, 0.5::DOUBLE * ({_PCT('semantic')}) + 0.5::DOUBLE * ({_PCT('share')}) AS relevance FROM cand), pool AS ({_POOLED(_TOP('r', 'relevance', 50, 'pool'))})
SELECT {_SHOWN}, round(hand, 6) AS hand FROM ({' UNION ALL BY NAME '.join(f"({_TOP('pool', m, 15, m)})" for m in ('relevance', 'hand', 'learned', 'blend'))})""")
def topic_orders(s, d):
    """Each area's pool of 50 in four orders."""
    return _rounded(pools.topic_orders(_candidates(s, d).drop("tagged"), 50)).withColumn("hand", F.round("hand", 6))


@query(f"""WITH {_CAND}, c AS (SELECT * EXCLUDE (semantic), semantic / 1000 AS relevance FROM cand WHERE semantic IS NOT NULL), near AS ({_POOLED(_TOP('c', 'relevance', 60, 'pool'))}), r AS (SELECT *, 0.5::DOUBLE * ({_PCT('relevance')}) + 0.5::DOUBLE * ({_PCT('share')}) AS mix FROM c),
own AS (SELECT * FROM r WHERE share >= 0.3 OR tagged), mixed AS ({_POOLED(_TOP('own', 'mix', 60, 'pool'))}), tags AS (SELECT * FROM near WHERE tagged)
SELECT {_SHOWN} FROM (({_TOP('near', 'relevance', 15, 'relevance')}) UNION ALL BY NAME ({_TOP('near', 'learned', 15, 'learned')}) UNION ALL BY NAME ({_TOP('near', 'blend', 15, 'blend')}) UNION ALL BY NAME ({_TOP('tags', 'learned', 15, 'tag')}) UNION ALL BY NAME ({_TOP('mixed', 'learned', 15, 'mix')}))""")
def tagged_orders(s, d):
    """Five orders of the 60 nearest, or best mixed, of each area."""
    rows = _candidates(s, d).where("semantic IS NOT NULL").withColumn("relevance", F.col("semantic") / 1000).drop("semantic", "hand")
    return _rounded(pools.tagged_orders(rows, 60))


# Judged lines: titles of documents are the sources, and the first words of one the quote.
_LINE = """SELECT doc_id, 'Edge AI-chip' AS phrase, {echo} AS echo, CASE WHEN doc_id % 13 > 0 THEN doc_id % 3 > 0 END AS signal, doc_id % 7 > 0 AS on_topic, doc_id % 2 = 0 AS verified, CASE WHEN doc_id % 9 > 0 THEN doc_id % 5 > 0 END AS sources_confirm, CASE WHEN doc_id % 6 = 0 THEN 'массовая' WHEN doc_id % 6 > 1 THEN 'новая' END AS mass,
 CASE WHEN doc_id % 10 = 0 THEN 'two words' ELSE replace(substr(text, 1, 30), ' ', ' - ') END AS quote, concat('u', {k}) AS url"""
_ECHOES = ("'edge ai chip'", "'Edge AI-chip — a name: what it is'", "'Another phrase'", "'Edge AI-chip- glued'", "'EDGE  AI CHIP - x - y'", "NULL")
_ECHO = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_ECHOES)) + " END"
_E = "array_to_string(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'), ' ')"
_Q = "array_to_string(regexp_extract_all(lower(coalesce({}, '')), '[a-zа-я0-9]+'), ' ')"


@query(f"""WITH x AS ({_LINE.format(echo=_ECHO, k='(doc_id % 4)::VARCHAR')}, text AS t, {_E.format('string_split(regexp_replace(' + _ECHO + ", '[ \\t\\n\\r\\f\\v][—–-][ \\t\\n\\r\\f\\v]', chr(1)), chr(1))[1]")} AS head, {_E.format(_ECHO)} AS whole, {_Q.format('quote')} AS q FROM documents),
y AS (SELECT *, len(string_split(q, ' ')) >= 3 AND contains({_Q.format('substr(t, 1, 200)')}, q) AS quote_ok FROM x WHERE (head = 'edge ai chip' OR whole = 'edge ai chip') AND signal IS NOT NULL AND on_topic IS NOT NULL)
SELECT doc_id, quote_ok, CASE WHEN url IN ('u0', 'u2') THEN url ELSE '' END AS url, signal AND on_topic AND (NOT verified OR (coalesce(sources_confirm, false) AND quote_ok AND coalesce(mass <> 'массовая', true))) AS accepted FROM y""")
def judged_lines(s, d):
    rows = s.sql(f"{_LINE.format(echo=_ECHO, k='CAST(doc_id % 4 AS STRING)')}, array(substr(text, 1, 200)) AS titles, array('u0', 'u2') AS urls FROM {{documents}}", documents=table(s, d, "documents"))
    return answers.checked(rows).select("doc_id", "quote_ok", "url", "accepted")


# Documents of candidates: pages are papers and documents repositories.
_PAPERS = "SELECT 'edge computing' AS phrase, concat('w', {id}) AS id, CASE WHEN page_id % 3 > 0 THEN concat('https://doi.org/10.1/', {id}) WHEN page_id % 2 = 0 THEN '' END AS doi, CASE WHEN page_id % 5 > 0 THEN substr(html, 1, 40) END AS title, CASE WHEN page_id % 4 > 0 THEN 'Reuters.com' END AS venue, CASE WHEN page_id % 2 = 0 THEN 'preprint' WHEN page_id % 7 > 0 THEN 'article' END AS kind, '2024-01-02' AS published, CASE WHEN page_id % 6 > 0 THEN 'de' ELSE '' END AS language, html AS text, CASE WHEN page_id % 8 = 0 THEN 'edges computings' WHEN page_id % 8 = 1 THEN 'edge computing' END AS via"
_REPOS = "SELECT 'edge computing' AS phrase, concat('org/r', {id}) AS full_name, CASE WHEN doc_id % 4 > 0 THEN text END AS description, concat('https://github.com/org/r', {id}) AS url, CASE WHEN doc_id % 3 > 0 THEN '2023-04-05T06:07:08Z' ELSE '' END AS created, CASE WHEN doc_id % 5 > 0 THEN doc_id % 100 END AS stars, CASE WHEN doc_id % 7 = 0 THEN 'computing at the edges' END AS via"
_HOST = r"lower(split_part(regexp_replace(coalesce(url, ''), '^https?://(www\.)?', ''), '/', 1))"


@query(f"""WITH p AS ({_PAPERS.format(id='page_id::VARCHAR')} FROM pages), r AS ({_REPOS.format(id='doc_id::VARCHAR')} FROM documents),
u AS (SELECT coalesce(title, '') AS title, coalesce(nullif(doi, ''), id) AS url, coalesce(venue, 'OpenAlex') AS source_name, CASE WHEN kind = 'preprint' THEN 'preprint' ELSE 'paper' END AS kind, published, coalesce(nullif(language, ''), 'en') AS language, substr(text, 1, 700) AS snippet, NULL::BIGINT AS stars, coalesce(nullif(via, ''), phrase) AS via, phrase FROM p
UNION ALL SELECT substr(full_name || ': ' || coalesce(description, ''), 1, 200), url, 'GitHub', 'repository', nullif(substr(created, 1, 10), ''), 'en', '', coalesce(stars, 0)::BIGINT, coalesce(nullif(via, ''), phrase), phrase FROM r)
SELECT md5(title) AS title, url, source_name, kind, published, language, md5(snippet) AS snippet, stars, array_to_string(list_transform(string_split(via, ' '), lambda w: {_STEM3}), ' ') AS attachment_normalized, CASE WHEN via = phrase THEN 'own' ELSE 'merged' END AS attachment_source,
 CASE WHEN regexp_matches(source_name, '{E.PRESS_HOSTS}') THEN 'C' WHEN kind = 'paper' OR regexp_matches({_HOST}, '{E.HIGH_HOSTS}') THEN 'A' ELSE 'B' END AS tier, 'OK' AS status FROM u""")
def concrete_documents(s, d):
    papers = s.sql(f"{_PAPERS.format(id='CAST(page_id AS STRING)')} FROM {{pages}}", pages=table(s, d, "pages"))
    repositories = s.sql(f"{_REPOS.format(id='CAST(doc_id AS STRING)')} FROM {{documents}}", documents=table(s, d, "documents"))
    made = claims.concrete_documents(papers, repositories, "2026-01-01")
    hashed = {c: F.md5(F.col(c).cast("binary")) for c in ("title", "snippet")}
    return made.withColumns(hashed).drop("phrase", "attachment", "retrieved")


@query("""WITH f AS (SELECT l_partkey AS entity, l_orderkey AS doc_id, o_orderstatus = 'O' AS p, CASE WHEN l_linenumber % 3 = 0 THEN [] WHEN l_linenumber % 2 = 0 THEN ['company', 'education'] ELSE [c_mktsegment] END AS i, CASE WHEN o_orderkey % 4 > 0 THEN c_nationkey END AS field FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
o AS (SELECT entity, doc_id, max(p::INT) AS p, list_distinct(flatten(list(i))) AS i FROM f GROUP BY ALL), n AS (SELECT entity, count(DISTINCT field)::BIGINT AS n_fields FROM f GROUP BY ALL)
SELECT entity, round(sum(p) / count(*), 6) AS preprint_share, round(coalesce(sum(list_contains(i, 'company')::INT) / nullif(sum(len(i)), 0), 0), 6) AS company_share, any_value(n_fields) AS n_fields FROM o JOIN n USING (entity) GROUP BY entity""")
def source_shares(s, d):
    """Parts in orders: open ones are preprints, segments and fixed types the institutions, nations the fields."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    kinds = F.when(F.col("l_linenumber") % 3 == 0, F.expr("cast(array() as array<string>)")).when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("company"), F.lit("education"))).otherwise(F.array("c_mktsegment"))
    found = rows.select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "preprint").otherwise("article").alias("kind"), kinds.alias("institutions"), F.when(F.col("o_orderkey") % 4 > 0, F.col("c_nationkey")).alias("field"))
    return answers.source_shares(found).withColumns({c: F.round(c, 6) for c in ("preprint_share", "company_share")})


_LAYERS = ("BUILDING", "FURNITURE", "MACHINERY")


@query(f"""WITH {TRADE_SQL}, n AS (SELECT entity, {', '.join(f"sum(df) FILTER (source = '{x}' AND year >= 1999) AS {x}" for x in _LAYERS)} FROM cube GROUP BY ALL),
l AS (SELECT entity, string_agg(printf('%.3f', share * 10000), ',' ORDER BY year) AS line FROM dense GROUP BY ALL),
c AS (SELECT entity, x, v FROM (SELECT entity, unnest({list(_LAYERS)}) AS x, unnest([BUILDING - 3, FURNITURE - 3, MACHINERY - 3]) AS v FROM n) WHERE v IS NOT NULL), t AS (SELECT entity, string_agg(x, ',' ORDER BY p) AS top FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(v) DESC, x) AS p FROM c) WHERE p <= 2 GROUP BY ALL)
SELECT entity, {" || ';' || ".join(f"'{x}:' || CASE WHEN {x} > 0 THEN 'true:' || {x}::VARCHAR || ' orders' ELSE 'false:none' END" for x in _LAYERS)} AS ladder, line, coalesce(top, '') AS top FROM n JOIN l USING (entity) LEFT JOIN t USING (entity)""")
def card_ladder(s, d):
    """Layers that a part has reached, its line of shares, and the two largest parts of a score."""
    counts = cube.count_cube(trade_found(s, d), once=True)
    sums = counts.groupBy("entity").agg(*[F.sum(F.when((F.col("source") == x) & (F.col("year") >= 1999), F.col("df"))).alias(x) for x in _LAYERS])
    parts = F.array(*[F.struct(F.lit(x).alias("label"), (F.col(x) - 3).cast("double").alias("value")) for x in _LAYERS])
    rows = sums.select("entity", sinks.ladder({x: (F.col(x), "orders") for x in _LAYERS}).alias("ladder"), sinks.largest(parts, 2).alias("top"))
    lines = sinks.share_line(axes.share_series(counts, trade_totals(s, d), 1995, 2001))
    text = F.array_join(F.transform("ladder", lambda x: F.concat_ws(":", x["layer"], x["present"].cast("string"), x["value"])), ";")
    return rows.join(lines, "entity").select("entity", text.alias("ladder"), F.array_join(F.transform("line", lambda v: F.format_string("%.3f", v)), ",").alias("line"), F.array_join(F.transform("top", lambda x: x["label"]), ",").alias("top"))


@query()
def overlapping_terms(s, d):
    """Phrases of about one support that hold one another or share half of their words; a test holds it to the plain loop."""
    from glimmer.plans.trade import _phrases as phrases

    return base.overlapping_dedup(phrases(s, d).select(F.col("phrase").alias("term"), F.col("volume").cast("double").alias("score"), F.col("volume").alias("support")))
