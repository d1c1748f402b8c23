"""Queries over the remaining rules and the building of the base of signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.functions import lexicon as L
from glimmer.functions import names as N
from glimmer.functions.text import entity_key
from glimmer.operators import axes, base, cube, history
from glimmer.operators.windows import Params
from glimmer.plans.panels import ORDER_IDS, PAST, TRADE_SQL, ids, query, table, text_docs, trade_found, trade_totals
from glimmer.plans.panels import TEXT_SQL
from glimmer.plans.rules import _PH, _phrases
from glimmer.plans.terms import _in


def _cube(s, d):
    return cube.count_cube(trade_found(s, d), once=True)


@query(f"""WITH {_PH}, w AS (SELECT phrase, string_split(replace(phrase, '_', ' '), ' ') AS w, string_split(phrase, ' ') AS t FROM ph)
SELECT phrase, len(list_filter(w, lambda x: x IN {_in(N.FOREIGN)})) >= 2 OR len(list_filter(w, lambda x: x IN {_in(N.FOREIGN_STRONG)})) > 0 AS is_foreign, len(list_filter(w, lambda x: regexp_matches(x, '{N.VERBS}'))) > 0 AS verb,
 CASE WHEN len(t) = 1 THEN CASE WHEN contains(phrase, '-') THEN phrase IN {_in(N.PLAIN)} ELSE phrase IN {_in(N.PLAIN)} OR regexp_matches(phrase, '{N.SUFFIXES}') END ELSE len(list_filter(t, lambda x: NOT (x IN {_in(N.PLAIN)} OR x LIKE '%ly'))) = 0 END AS plain FROM w""")
def language_and_verbs(s, d):
    p = F.col("phrase")
    return _phrases(s, d).select("phrase", N.is_foreign(p).alias("is_foreign"), N.has_verb(p).alias("verb"), N.is_plain(p).alias("plain"))


@query(rf"""WITH {TEXT_SQL}, t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9\-]+') AS t FROM tdocs), n AS (SELECT doc_id, t, unnest([2, 3, 4]) AS n FROM t), g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: t[i:i + n - 1])) AS g FROM n WHERE len(t) >= n)
SELECT doc_id, count(DISTINCT array_to_string(g, ' '))::BIGINT AS n, min(array_to_string(g, ' ')) AS first FROM g WHERE g[1] NOT IN {_in(N.STOP)} AND g[len(g)] NOT IN {_in(N.STOP)} AND g[len(g)] NOT IN {_in(N.HEADS)} AND len(list_filter(g, lambda w: w IN {_in(N.INNER)})) = 0 AND len(list_filter(g, lambda w: w NOT IN {_in(N.STOP)})) >= 2 GROUP BY ALL""")
def query_phrases(s, d):
    rows = text_docs(s, d).select("doc_id", F.explode(N.query_phrases(F.col("text"))).alias("p"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"))


_MINUS = lambda when, x: f"CASE WHEN {when} THEN {x} ELSE 0 END"
_ANY = lambda words: f"len(list_filter(w, lambda x: x IN {_in(words)})) > 0"
_WEAK = _in(L.GENERIC_MODIFIERS | L.PARTICIPLE_MODIFIERS | L.FUNCTION_WORDS | N.CATEGORIES | N.DISCOURSE | N.ARTIFACTS | N.MODEL_CLASSES | N.PLUMBING | N.BRANDS | N.AMBIGUOUS_BRANDS)
_META = _in(N.RESEARCH_WORDS | N.DISCOURSE | N.ARTIFACTS | N.CATEGORIES | N.MODEL_CLASSES | L.FUNCTION_WORDS | N.INTENT)


@query(f"""WITH {_PH}, w AS (SELECT phrase, regexp_extract_all(lower(phrase), '[a-z0-9]+') AS w, regexp_extract_all(lower(phrase), '[a-z0-9]+(?:-[a-z0-9]+)*') AS hy, length(phrase) % 3 AS ch, length(phrase) % 2 AS lit, starts_with(phrase, 'a') AS seed FROM ph),
r AS (SELECT *, round(least(greatest(0.5::DOUBLE + CASE WHEN lit >= 1 THEN 0.2 ELSE 0 END + CASE WHEN ch >= 2 THEN 0.2 ELSE 0 END + CASE WHEN seed THEN 0.1 ELSE 0 END - CASE WHEN ch <= 1 AND NOT seed AND lit = 0 THEN 0.4 ELSE 0 END, 0), 1) + 1e-9, 3) AS relevance, list_filter(w, lambda x: x NOT IN {_WEAK} AND x <> 'waste' AND length(x) > 2) AS sp, w[len(w)] AS head, hy[len(hy)] AS last FROM w),
q AS (SELECT *, round(least(greatest(1::DOUBLE - {_MINUS(f"head IN {_in(N.CATEGORIES)}", 0.35)} - {_MINUS(f"head IN {_in(N.MODEL_CLASSES)}", 0.35)} - {_MINUS(_ANY(N.PLUMBING), 0.25)} - {_MINUS(_ANY(N.AMBIGUOUS_BRANDS), 0.25)} + {_MINUS("len(sp) >= 2", 0.1)}, 0), 1) + 1e-9, 3) AS specificity FROM r)
SELECT phrase, relevance::DOUBLE AS relevance, CASE WHEN len(w) NOT BETWEEN 2 AND 4 THEN 'length' WHEN len(list_filter(w, lambda x: length(x) > 2)) = 0 THEN 'short_tokens' WHEN {_ANY(N.BRANDS)} THEN 'brand' WHEN {_ANY(N.FURNITURE)} THEN 'furniture'
 WHEN w[1] LIKE '%ing' AND w[1] NOT IN {_in(N.GERUND_NOUNS)} AND w[1] NOT IN {_in(L.GENERIC_MODIFIERS)} AND length(w[1]) > 5 THEN 'gerund'
 WHEN last NOT IN {_in(N.NOUN_EXCEPTIONS)} AND replace(last, '-', '') NOT IN {_in(N.NOUN_EXCEPTIONS)} AND (regexp_matches(last, '{N.ADJECTIVE_ENDS}') OR (last LIKE '%al' AND length(last) > 5)) THEN 'adjective'
 WHEN head IN {_in(N.DISCOURSE)} THEN 'discourse' WHEN {_ANY(N.AMBIGUOUS_BRANDS)} AND len(sp) = 0 THEN 'ambiguous_brand' WHEN len(sp) = 0 THEN 'nothing_specific' WHEN len(list_filter(w, lambda x: x NOT IN {_META})) = 0 THEN 'meta_concept' WHEN list_contains(w, 'ring') OR list_contains(w, 'red') THEN 'excluded' WHEN specificity < 0.7 AND relevance < 0.4 THEN 'weak' END AS reason, specificity::DOUBLE AS specificity FROM q""")
def candidate_assess(s, d):
    """The query's own word is "waste"; its plan rules out "ring" and "red"."""
    p, of = F.col("phrase"), lambda *v: F.array(*[F.lit(x) for x in v])
    rel = N.domain_relevance(p.startswith("a"), F.length(p) % 3, F.length(p) % 2)
    return _phrases(s, d).withColumn("relevance", rel).withColumn("a", N.assessed(p, F.col("relevance"), of("waste"), of("ring", "red"))).select("phrase", "relevance", "a.reason", "a.specificity")


_GROUPS = ("ax:q-bio.NC", "ax:quant-ph", "oa:2208", "ax:physics.optics", "ax:cs.LG", "oa:1404", "ax:math.ST", "other")
_SCI = [("biology", r"^ax:(q-bio|physics\.(bio|med)-ph)"), ("finance", r"^(ax:(q-fin|econ)|oa:(1404|2003))"), ("quantum", r"^ax:quant-ph"), ("optics", r"^(ax:physics\.(optics|app-ph)|oa:3107)"), ("physics", r"^ax:(physics|hep|astro)"), ("electrical", r"^(ax:eess|oa:2208)"), ("mathematics", r"^ax:(stat\.|math)")]


@query("WITH g AS (SELECT id, " + str(list(_GROUPS)) + "[1 + id % 8] AS g FROM (SELECT c_custkey AS id FROM customer) t) SELECT id, CASE " + " ".join(f"WHEN regexp_matches(g, '{p}') THEN '{n}'" for n, p in _SCI) + " ELSE 'informatics' END AS science FROM g")
def science_of_group(s, d):
    g = ids(s, d, "customer", "c_custkey").withColumn("g", F.array(*[F.lit(x) for x in _GROUPS])[(F.col("id") % 8).cast("int")])
    return g.select("id", N.first_match(F.col("g"), _SCI, "informatics").alias("science"))


_LEX = {"infra": r"\b(memory|ethernet|chip)\b", "agents": r"\b(agent|agentic)\b", "models": r"\b(model|models|network)\b", "edge": r"\b(shot|server|context)\b"}
_NEVER = r"\b(series|market)\b"


@query(f"""WITH {_PH}, x AS (SELECT phrase, replace(phrase, '_', ' ') AS t, length(phrase) % 7 / 10.0 AS sh, CASE WHEN length(phrase) % 2 = 0 THEN ['infra', 'models'] ELSE ['agents'] END AS l FROM ph),
a AS (SELECT phrase, list_filter([CASE WHEN regexp_matches(t, '{_LEX['infra']}') OR (sh >= 0.3 AND list_contains(l, 'infra')) THEN 'infra' END, CASE WHEN (regexp_matches(t, '{_LEX['agents']}') OR sh >= 0.3 OR list_contains(l, 'agents')) AND NOT regexp_matches(t, '{_NEVER}') THEN 'agents' END, CASE WHEN regexp_matches(t, '{_LEX['models']}') OR list_contains(l, 'models') THEN 'models' END, CASE WHEN regexp_matches(string_split(t, ' ')[1] || ' ' || coalesce(string_split(t, ' ')[2], ''), '{_LEX['edge']}') THEN 'edge' END], lambda v: v IS NOT NULL) AS a FROM x)
SELECT phrase, array_to_string(a, ',') AS areas, CASE WHEN list_contains(a, 'models') THEN 'models' WHEN list_contains(a, 'infra') THEN 'infra' WHEN list_contains(a, 'agents') THEN 'agents' WHEN list_contains(a, 'edge') THEN 'edge' ELSE 'other' END AS main FROM a""")
def area_lexicon(s, d):
    """One strict area, one that words rule out, and one whose subject words count in the first two words only."""
    share, words = F.length("phrase") % 7 / 10.0, F.split(F.replace(F.col("phrase"), F.lit("_"), F.lit(" ")), " ")
    labels = F.when(F.length("phrase") % 2 == 0, F.array(F.lit("infra"), F.lit("models"))).otherwise(F.array(F.lit("agents")))
    found = N.areas(F.col("phrase"), _LEX, {"infra": share, "agents": share}, labels, ("infra", "edge"), never={"agents": _NEVER}, own_text={"edge": F.array_join(F.slice(words, 1, 2), " ")})
    rows = _phrases(s, d).withColumn("a", found)
    return rows.select("phrase", F.array_join("a", ",").alias("areas"), N.main_area(F.col("a"), ["models", "infra", "agents", "edge"]).alias("main"))


@query(f"WITH {TRADE_SQL}, v AS (SELECT entity, sum(docs) AS v FROM dense GROUP BY ALL), r AS (SELECT entity, row_number() OVER (ORDER BY v, entity) AS p, count(*) OVER () AS n FROM v) SELECT entity, greatest(ceil((p - 1) * 10 / (n - 1)) - 1, 0)::INT AS stratum FROM r")
def decile_strata(s, d):
    v = axes.share_series(_cube(s, d), trade_totals(s, d), 1995, 2001).groupBy("entity").agg(F.sum("docs").alias("v"))
    return base.decile_strata(v, "v", "entity").select("entity", "stratum")


@query(f"""WITH {TRADE_SQL}, a AS (SELECT entity, coalesce(sum(df) FILTER (year BETWEEN 1995 AND 1997), 0)::BIGINT AS d_now, coalesce(sum(df) FILTER (year BETWEEN 1999 AND 2001), 0)::BIGINT AS d_future FROM cube GROUP BY ALL), t AS (SELECT sum(n_docs) FILTER (year BETWEEN 1995 AND 1997) AS n, sum(n_docs) FILTER (year BETWEEN 1999 AND 2001) AS f FROM totals)
SELECT entity, (d_future / f + 1e-9) / (d_now / n + 1e-9) >= 1.5 AND d_future >= 3 AND d_now <= 8 AND (entity % 4 = 0 OR entity % 5 < 3) AS takeoff FROM a, t""")
def takeoff_small(s, d):
    labels = history.takeoff_label(_cube(s, d), trade_totals(s, d), PAST, (1999, 2001))
    return history.small_takeoff(labels, 8, F.when(F.col("entity") % 4 != 0, (F.col("entity") % 5).cast("double"))).select("entity", "takeoff")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer JOIN (VALUES ('BUILDING', 3), ('MACHINERY', 5), ('FURNITURE', 1)) q(seg, quota) ON seg = c_mktsegment QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= quota")
def quota_selection(s, d):
    q = s.createDataFrame([("BUILDING", 3), ("MACHINERY", 5), ("FURNITURE", 1)], "c_mktsegment string, quota int")
    return base.with_quota(table(s, d, "customer"), q, "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "c_mktsegment", "rank")


@query()
def nested_terms(s, d):
    """Nested phrases of nearly one support; a test holds it against the plain loop."""
    from glimmer.plans.trade import _phrases as phrases

    return base.nested_dedup(phrases(s, d).select(F.col("phrase").alias("term"), F.col("volume").cast("double").alias("score"), F.col("volume").alias("support")))


@query("WITH o AS (SELECT array_to_string(list_sort(list_distinct(list_transform(string_split(lower(p_name), ' '), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:length(w) - 3] || 'y' WHEN length(w) > 4 AND w LIKE '%sses' THEN w[:length(w) - 2] WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is' OR w LIKE '%ics') THEN w[:length(w) - 1] ELSE w END))), ' ') AS k, p_partkey, p_brand FROM part), l AS (SELECT k, arg_max(p_brand, p_partkey) AS verdict FROM o WHERE p_partkey % 3 = 0 GROUP BY ALL) SELECT p_partkey, verdict FROM o LEFT JOIN l USING (k) WHERE p_partkey % 3 <> 0")
def label_transfer(s, d):
    p = table(s, d, "part").select("p_partkey", F.lower("p_name").alias("name"), "p_brand")
    old = p.where("p_partkey % 3 = 0").select("name", F.col("p_brand").alias("verdict"), F.col("p_partkey").alias("version"))
    return base.transferred(p.where("p_partkey % 3 <> 0"), old, entity_key(F.col("name"))).select("p_partkey", "verdict")


_R = "r AS (SELECT id, id % 6 = 0 AS rejected, id * 37 % 211 AS score, id % 9 AS area, id % 5 = 0 AS fragment, id % 7 = 0 AS umbrella, CASE WHEN id % 4 > 0 THEN (id % 10) / 10.0 END AS theory, id % 11 = 0 AS known, CASE WHEN id % 3 > 0 THEN (id * 13 % 97) / 97.0 END AS e, (id * 29 % 89) / 89.0 AS h FROM " + ORDER_IDS + " t)"


def _rows(s, d):
    return ids(s, d).selectExpr("id", "id % 6 = 0 AS rejected", "id * 37 % 211 AS score", "id % 9 AS area", "id % 5 = 0 AS fragment", "id % 7 = 0 AS umbrella", "if(id % 4 > 0, (id % 10) / 10.0, null) AS theory_share", "id % 11 = 0 AS known", "if(id % 3 > 0, cast(id * 13 % 97 AS double) / 97, null) AS e", "cast(id * 29 % 89 AS double) / 89 AS h")


@query(f"WITH {_R} SELECT id, CASE WHEN rejected THEN 1 WHEN row_number() OVER (PARTITION BY rejected ORDER BY score DESC, id) <= 20 THEN 3 WHEN row_number() OVER (PARTITION BY rejected ORDER BY score DESC, id) <= 80 THEN 2 ELSE 1 END::INT AS stage FROM r")
def cascade_stages(s, d):
    return base.cascade(_rows(s, d), (80, 20), "score", "id").select("id", "stage")


@query("WITH f AS (SELECT id % 60 AS query, CASE WHEN id * 7 % 90 = 0 THEN 'external' WHEN id * 11 % 40 = 0 THEN 'internal' END AS kind FROM (SELECT c_custkey AS id FROM customer) t) SELECT query, CASE WHEN bool_or(coalesce(kind = 'external', false)) THEN 'PROVIDER_ERROR' WHEN bool_or(coalesce(kind = 'internal', false)) THEN 'INCOMPLETE_SEARCH' ELSE 'COMPLETE' END AS state FROM f GROUP BY ALL")
def search_completeness(s, d):
    f = ids(s, d, "customer", "c_custkey").selectExpr("id % 60 AS query", "'x' AS source", "CASE WHEN id * 7 % 90 = 0 THEN 'external' WHEN id * 11 % 40 = 0 THEN 'internal' END AS kind")
    return base.completeness_state(f)


@query(f"WITH {_R}, p AS (SELECT id, CASE WHEN e IS NOT NULL THEN (rank() OVER (PARTITION BY e IS NULL ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2) / count(*) OVER (PARTITION BY e IS NULL) END AS pe, (rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2) / count(*) OVER () AS ph FROM r) SELECT id, round(0.7 * pe + 0.3 * ph, 6)::DOUBLE AS blend FROM p")
def expert_history_blend(s, d):
    return base.blended(_rows(s, d), "e", "h").select("id", F.round("blend", 6).alias("blend"))


@query(f"WITH {_R}, f AS (SELECT * FROM r WHERE NOT fragment AND NOT umbrella AND coalesce(theory, 0) < 0.6 AND NOT known), p AS (SELECT id, area, (rank() OVER (PARTITION BY area ORDER BY h) + (count(*) OVER (PARTITION BY area, h) - 1) / 2) / count(*) OVER (PARTITION BY area) AS pct FROM f) SELECT id, area, CASE WHEN pct >= 1 - 0.6::DOUBLE / 3 THEN 1 WHEN pct >= 1 - 2 * 0.6::DOUBLE / 3 THEN 2 ELSE 3 END::INT AS tier FROM p WHERE pct >= 1 - 0.6::DOUBLE")
def signal_base(s, d):
    return base.signal_base(_rows(s, d).withColumn("blend", F.col("h")), 0.6).select("id", "area", "tier")


@query(f"WITH {_PH}, x AS (SELECT phrase, 2018 + length(phrase) % 9 AS first_year, length(phrase) * 3 % 20 AS volume, length(phrase) * 7 % 11 / 4.0 AS growth FROM ph), f AS (SELECT * FROM x WHERE first_year >= 2023 AND volume >= 5 AND growth >= 1.5 AND regexp_matches(phrase, 'agent|memory|model|protocol') AND NOT regexp_matches(phrase, 'ultra') AND NOT regexp_matches(phrase, '\\d') AND phrase NOT LIKE 'zero%'), p AS (SELECT phrase, (rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2) / count(*) OVER () + (rank() OVER (ORDER BY growth) + (count(*) OVER (PARTITION BY growth) - 1) / 2) / count(*) OVER () AS rank FROM f) SELECT phrase, round(rank, 6)::DOUBLE AS rank FROM p")
def market_candidates(s, d):
    x = _phrases(s, d).select("phrase", (2018 + F.length("phrase") % 9).alias("first_year"), (F.length("phrase") * 3 % 20).alias("volume"), (F.length("phrase") * 7 % 11 / 4.0).alias("growth"))
    known = x.where("phrase LIKE 'zero%'")
    return base.market_candidates(x, "agent|memory|model|protocol", "ultra", known).select("phrase", F.round("rank", 6).alias("rank"))


@query("WITH v AS (SELECT id // 5 AS query_id, id % 5 AS area, (id * 7 % 30) / 10.0 AS vote FROM (SELECT c_custkey AS id FROM customer) t WHERE id % 3 > 0), n AS (SELECT id // 5 AS query_id, id % 5 AS area, (id * 11 % 40) / 100.0 AS similarity FROM (SELECT c_custkey AS id FROM customer) t), b AS (SELECT query_id, arg_max(area, row(similarity, area)) AS area, max(similarity) AS s FROM n GROUP BY ALL) SELECT query_id, CASE WHEN s >= 0.38 OR coalesce(vote, 0) >= 2.5 OR (s >= 0.3 AND coalesce(vote, 0) >= 1.2) THEN area END AS area FROM b LEFT JOIN v USING (query_id, area)")
def area_decision(s, d):
    votes = ids(s, d, "customer", "c_custkey").where("id % 3 > 0").selectExpr("id div 5 AS query_id", "id % 5 AS area", "cast(id * 7 % 30 AS double) / 10 AS vote")
    named = ids(s, d, "customer", "c_custkey").selectExpr("id div 5 AS query_id", "id % 5 AS area", "cast(id * 11 % 40 AS double) / 100 AS similarity")
    return base.area_decision(votes, named, 0.38, 2.5, 0.3, 1.2)


@query(f"WITH {_R}, c AS (SELECT id, score, CASE WHEN known THEN 'mature' END AS code FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY code IS NULL ORDER BY score DESC, id) AS place FROM c) SELECT string_agg(id::VARCHAR, ',' ORDER BY place) FILTER (code IS NULL AND place <= 15) AS shown, string_agg(id::VARCHAR, ',' ORDER BY place) FILTER (code IS NULL AND place > 15 AND place <= 60) AS more, string_agg(id::VARCHAR, ',' ORDER BY place) FILTER (code IS NOT NULL AND place <= 60) AS excluded, count(*)::BIGINT AS n, count(code)::BIGINT AS n_excluded FROM p")
def answer_lists(s, d):
    return base.answer(_rows(s, d).select(F.col("id").alias("key"), F.col("score").alias("order"), F.when(F.col("known"), "mature").alias("code")))


@query("WITH r AS (SELECT id, CASE WHEN id % 3 > 0 THEN id * 17 % 900 END AS oa_total, CASE WHEN id % 4 > 0 THEN (id % 20) / 10.0 END AS oa_peak_ratio, id % 9 AS news_30d, id % 50 AS news_1y, id % 40 AS hn_12m, CASE WHEN id % 5 > 0 THEN id % 30 END AS hn_prior24m, CASE WHEN id % 2 > 0 THEN id * 31 % 5000 END AS gh_total FROM (SELECT c_custkey AS id FROM customer) t) SELECT id, round(ln(1 + coalesce(oa_total, 0)), 6) AS oa_total_log, coalesce(oa_peak_ratio, 1)::DOUBLE AS oa_peak_ratio, round(news_30d / greatest(1, news_1y), 6) AS news_30d_share, round(ln((hn_12m + 1) / (coalesce(hn_prior24m, 0) / 2 + 1)), 6) + 0.0 AS hn_growth, round(ln(1 + coalesce(gh_total, 0)), 6) AS gh_total_log FROM r")
def model_features(s, d):
    r = ids(s, d, "customer", "c_custkey").selectExpr("id", "if(id % 3 > 0, id * 17 % 900, null) AS oa_total", "if(id % 4 > 0, cast(id % 20 AS double) / 10, null) AS oa_peak_ratio", "id % 9 AS news_30d", "id % 50 AS news_1y", "id % 40 AS hn_12m", "if(id % 5 > 0, id % 30, null) AS hn_prior24m", "if(id % 2 > 0, id * 31 % 5000, null) AS gh_total")
    f = base.features(r)
    return f.select("id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in f.columns[1:]])


@query("WITH x AS (SELECT id, ['science', 'code', 'media'][1 + id % 3] AS family, unnest(CASE id % 3 WHEN 0 THEN ['existence', 'research'] WHEN 1 THEN ['existence', 'implementation'] ELSE ['existence'] END) AS claim FROM (SELECT c_custkey AS id FROM customer) t) SELECT claim, string_agg(DISTINCT family, ',' ORDER BY family) AS families, array_to_string(list_sort(list(id))[:5], ',') AS documents FROM x GROUP BY ALL")
def claim_tables(s, d):
    from glimmer.operators.evidence import claims

    rows = ids(s, d, "customer", "c_custkey").select("id", F.array(F.lit("science"), F.lit("code"), F.lit("media"))[(F.col("id") % 3).cast("int")].alias("family"))
    return base.claim_table(rows.withColumn("claims", claims(F.col("family"), F.lit("A"))))


@query("WITH t AS (SELECT c_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS t FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL) SELECT k, t[4] AS held_out FROM t")
def held_out_titles(s, d):
    t = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("t"))
    return t.select("k", base.held_out_title(F.col("t"), 3).alias("held_out"))


@query("WITH m AS (SELECT p_name AS phrase, max(p_size) AS label FROM part GROUP BY ALL) SELECT lower(phrase) AS phrase, max(label)::INT AS label FROM m GROUP BY 1")
def pseudo_labels(s, d):
    """The largest label that any row of a phrase has."""
    return table(s, d, "part").groupBy(F.lower("p_name").alias("phrase")).agg(F.max("p_size").cast("int").alias("label"))


@query()
def signal_cards(s, d):
    """Nested cards as JSON: facts, yearly line, sources."""
    from glimmer.plans.trade import _scored
    from glimmer.sources import sinks

    rows = _scored(s, d).where("candidate")
    sources = trade_found(s, d).groupBy("entity", F.col("source").alias("layer")).agg(F.count(F.lit(1)).alias("rank")).withColumn("title", F.concat("layer", F.lit(" "), F.col("entity").cast("string")))
    cards = sinks.cards(rows, axes.share_series(_cube(s, d), trade_totals(s, d), 1995, 2001), sources, Params(cutoff=2001))
    return cards.select("entity", F.to_json(F.struct("facts", "line", "sources")).alias("card"))
