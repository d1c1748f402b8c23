"""Queries on rules: names, evidence, decisions, ranking, calibration.

Cases are made from the keys of the driver's tables by arithmetic that both engines read alike, so that every branch is met
at every scale; phrases are made of the tables' own words and of words that the rules know.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.functions import lexicon as L
from glimmer.functions import text as X
from glimmer.operators import evidence as E
from glimmer.operators import rank as R
from glimmer.operators.graph import connected_components
from glimmer.plans.panels import ORDER_IDS, ids, query, table
from glimmer.plans.terms import _in

_FIRST = ("ai", "time", "zero", "multi", "quantum", "agentic", "based", "model", "openai", "meta", "awesome", "deploying", "learning", "horizon", "smart", "la", "hardware", "unlocking", "spark", "mining", "weak")
_INNER = ("series", "agent", "shot", "context", "network", "ultra", "learning", "trend", "signal", "server", "emerging", "de", "ai-driven")
_LAST = ("protocol", "systems", "driven", "ethernet", "memory", "aware", "models", "embedded", "report", "optical", "tool", "mining", "physics", "caches", "ai", "boxes", "unlocks", "analysis", "market", "visual", "scanning", "signal", "api")
_WHOLE = ("sistem untuk murid", "la red de", "doping unlocks growth", "scalable robust", "amine-grafted", "learning quickly", "topology governs spin", "emerging", "advanced smart", "resilience", "ieee 802", "v2.1 release", "open source", "a2a", "neural_network models", "cost aware pricing", "fips 140", "fips 140 module", "mcp security", "horizon scanning", "meta ai system", "weak optical signal", "mining waste sensor", "financial ai", "tpu xs", "symmetry engineered", "crystal optics")


def _pick(words, at: str) -> tuple[str, str]:
    """An element by a number, in Spark's SQL and in DuckDB's."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"element_at(array({listed}), cast(1 + ({at}) % {len(words)} AS int))", f"([{listed}])[1 + ({at}) % {len(words)}]"


def _phrase(dialect: int) -> str:
    a, b, c, w = (_pick(x, at)[dialect] for x, at in ((_FIRST, "p_partkey * 7 + p_size"), (_INNER, "p_partkey * 3 + p_size"), (_LAST, "p_partkey * 11 + p_size"), (_WHOLE, "p_partkey + p_size")))
    return f"CASE p_partkey % 5 WHEN 0 THEN concat_ws(' ', {a}, {c}) WHEN 1 THEN concat_ws(' ', {a}, {b}, {c}) WHEN 2 THEN concat_ws(' ', lower(p_name), {c}) WHEN 3 THEN concat_ws(' ', {b}, lower(p_type), {c}) ELSE {w} END"


_PH = f"ph AS (SELECT DISTINCT {_phrase(1)} AS phrase FROM part)"


def _phrases(s, d):
    return table(s, d, "part").selectExpr(f"{_phrase(0)} AS phrase").distinct()


@query(f"""WITH {_PH}, w AS (SELECT phrase, replace(phrase, '_', ' ') AS p, string_split(replace(phrase, '_', ' '), ' ') AS w FROM ph)
SELECT phrase, NOT ({' OR '.join(f"starts_with(p, '{t}')" for t in L.FRAGMENT_FINE)}) AND CASE WHEN w[1] IN ('multi', 'hardware') AND len(w) >= 3 THEN w[len(w)] IN {_in(L.FRAGMENT_END)} ELSE w[1] IN {_in({*L.FRAGMENT_START, 'multi', 'hardware'})} OR w[len(w)] IN {_in(L.FRAGMENT_END)} END AS fragment,
 len(w) BETWEEN 2 AND 4 AND len(list_filter(w, lambda x: x IN {_in(L.UMBRELLA_HEADS)})) > 0 AND len(list_filter(w, lambda x: x NOT IN {_in(L.UMBRELLA_HEADS | L.UMBRELLA_WORDS)})) = 0 AS umbrella,
 len(list_filter(string_split(phrase, ' '), lambda x: x NOT IN {_in(L.GENERIC)})) = 0 AS generic FROM w""")
def name_rules(s, d):
    p = F.col("phrase")
    return _phrases(s, d).select("phrase", X.is_fragment(p).alias("fragment"), X.is_umbrella(p).alias("umbrella"), X.is_generic(p).alias("generic"))


_STD, _XSTD = L.STANDARD, L.EXCLUDED_STANDARD


@query(f"WITH {_PH} SELECT phrase, regexp_matches(replace(phrase, '_', ' '), '(?i){_STD}') AS named, regexp_matches(trim(replace(phrase, '_', ' ')), '(?i)(?:{_XSTD})\\s*$') OR (length(phrase) % 3 = 0 AND regexp_matches(replace(phrase, '_', ' '), '(?i){_XSTD}')) AS standard FROM ph")
def standards(s, d):
    kind = F.when(F.length("phrase") % 3 == 0, "protocol").otherwise("other")
    return _phrases(s, d).select("phrase", X.has_standard(F.col("phrase")).alias("named"), X.is_standard(F.col("phrase"), kind).alias("standard"))


@query(f"WITH {_PH}, w AS (SELECT phrase, string_split(phrase, ' ') AS w FROM ph) SELECT phrase, regexp_matches(w[len(w)], '{L.ADJECTIVE_HEAD}') AND w[len(w)] NOT IN {_in(L.ADJECTIVE_NOUNS)} AS adjective FROM w")
def adjective_heads(s, d):
    return _phrases(s, d).select("phrase", X.adjective_head(F.col("phrase")).alias("adjective"))


_ST = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:length(w) - 3] || 'y' WHEN length(w) > 4 AND w LIKE '%sses' THEN w[:length(w) - 2] WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is' OR w LIKE '%ics') THEN w[:length(w) - 1] ELSE w END"
_VST = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:length(w) - 3] || 'y' WHEN length(w) > 4 AND (w LIKE '%ses' OR w LIKE '%xes' OR w LIKE '%zes' OR w LIKE '%ches' OR w LIKE '%shes') THEN w[:length(w) - 2] WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN w[:length(w) - 1] ELSE w END"
_PLAIN = _in(L.GENERIC_MODIFIERS | L.PARTICIPLE_MODIFIERS | L.FUNCTION_WORDS)


@query(f"WITH {_PH} SELECT phrase, array_to_string(list_sort(list_distinct(list_transform(string_split(phrase, ' '), lambda w: CASE WHEN contains(w, '_') THEN w ELSE {_ST} END))), ' ') AS entity_key, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(phrase), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN {_PLAIN}), lambda w: {_VST}))), ' ') AS merge_key FROM ph")
def phrase_keys(s, d):
    return _phrases(s, d).select("phrase", X.entity_key(F.col("phrase")).alias("entity_key"), X.merge_key(F.col("phrase")).alias("merge_key"))


#: name -> arithmetic over id that both engines read alike.
_EVIDENCE = {
    "candidate": "id", "ok_openalex": "id % 11 <> 0", "ok_github": "id % 7 <> 0", "ok_hn": "id % 5 <> 0", "ok_news": "id % 6 <> 0", "ok_wiki": "id % 4 <> 0",
    "burst": "(id * 13 % 80) / 10.0", "oa_growth": "(id * 7 % 40) / 10.0 - 1", "oa_last_share": "(id * 3 % 10) / 10.0", "oa_age": "id * 5 % 15", "oa_preprint_share": "(id * 11 % 10) / 10.0",
    "oa_total": "(id * 37 % 60) * (id * 37 % 60)", "oa_fields": "id % 8", "oa_prior": "CASE WHEN id % 3 = 0 THEN 0 ELSE id * 17 % 400 END", "oa_peak_ratio": "(id % 12) / 10.0", "oa_peak_year": "2018 + id % 9",
    "gh_new_share": "(id * 19 % 10) / 10.0", "gh_12m": "id * 23 % 300", "hn_growth": "(id * 29 % 40) / 10.0 - 1", "news_30d_share": "(id * 31 % 40) / 100.0", "news_press_share": "(id * 41 % 100) / 100.0", "news_1y": "id * 43 % 60",
    "wiki_article": "CASE WHEN id % 13 < 3 THEN 1 ELSE 0 END", "wiki_age": "id * 3 % 9", "n_documents": "id * 47 % 7", "n_promo": "id % 4", "n_supporting": "CASE WHEN id % 3 = 1 THEN 0 ELSE id % 4 END", "n_irrelevant_primary": "id % 2",
    "syndication_rate": "(id * 53 % 7) / 10.0", "origin_concentration": "CASE WHEN id % 9 = 0 THEN 1.0 ELSE 0.5 END", "science_document": "id % 10 < 6", "independent_supports": "id % 4", "distinct_origins": "1 + id % 3",
    "n_families": "id * 59 % 4", "has_science": "id % 3 <> 2", "lead_only": "id % 2 = 0", "completeness": "(id * 61 % 11) / 10.0", "stale": "id % 17 = 0", "noise": "id % 23 = 0",
}
_INT = {"candidate", "oa_age", "oa_total", "oa_fields", "oa_prior", "oa_peak_year", "gh_12m", "news_1y", "wiki_article", "wiki_age", "n_documents", "n_promo", "n_supporting", "n_irrelevant_primary", "independent_supports", "distinct_origins", "n_families"}
_GH = "CASE WHEN id % 5 < 2 THEN id * 67 % 9000 END"
_VER = "CASE WHEN id % 4 = 3 THEN 'DETERMINISTIC_ONLY' ELSE 'SEMANTICALLY_VERIFIED' END"


def _rows(s, d):
    kind = lambda n, x: f"CAST({x} AS BIGINT) AS {n}" if n in _INT else f"{x} AS {n}" if "<>" in x or n in ("science_document", "lead_only", "stale", "noise") else f"CAST({x} AS DOUBLE) AS {n}"
    return ids(s, d).selectExpr(*[kind(n, x) for n, x in _EVIDENCE.items()], f"CAST({_GH} AS BIGINT) AS gh_total", f"{_VER} AS verification")


def _clip(x):
    return f"least(greatest({x}, 0), 1)"


def _sat(x, k):
    return _clip(f"ln(1 + greatest({x}, 0)) / ln(1 + {k})")


_PARTS = {"volume": ("ok_openalex", _sat("oa_total", 3000), 0.28), "age": ("ok_openalex", _clip("oa_age / 10"), 0.20), "breadth": ("ok_openalex", _clip("oa_fields / 6"), 0.16), "persistence": ("ok_openalex", _sat("oa_prior", 300), 0.16), "encyclopedia": ("ok_wiki", f"CASE WHEN wiki_article > 0 THEN {_clip('0.3 + 0.7 * ' + _clip('wiki_age / 8'))} ELSE 0 END", 0.20), "adoption": ("gh_total IS NOT NULL", _sat("gh_total", 5000), 0.10)}
_TOP = " + ".join(f"CASE WHEN {ok} THEN {w} * ({x}) ELSE 0 END" for ok, x, w in _PARTS.values())
_WEIGHT = " + ".join(f"CASE WHEN {ok} THEN {w} ELSE 0 END" for ok, _, w in _PARTS.values())
_FULL = " AND ".join(ok for ok, _, _ in _PARTS.values())
_EV = f"""ev AS (SELECT {", ".join(f"{x} AS {n}" for n, x in _EVIDENCE.items())}, {_GH} AS gh_total, {_VER} AS verification FROM {ORDER_IDS} t),
e1 AS (SELECT *, round({_clip(f"0.30 * CASE WHEN ok_openalex THEN {_clip('0.5 * ' + _clip('burst / 6') + ' + 0.5 * ' + _clip('oa_growth / 2.5'))} ELSE 0 END + 0.15 * CASE WHEN ok_openalex THEN {_clip('0.6 * ' + _clip('oa_last_share / 0.5') + ' + 0.4 * ' + _clip('1 - oa_age / 10'))} ELSE 0 END + 0.25 * CASE WHEN ok_github THEN {_clip('0.6 * ' + _clip('gh_new_share / 0.6') + ' + 0.4 * ' + _sat('gh_12m', 200))} ELSE 0 END + 0.15 * greatest(CASE WHEN ok_hn THEN {_clip('hn_growth / 2')} ELSE 0 END, CASE WHEN ok_news THEN {_clip('news_30d_share / 0.25')} ELSE 0 END) + 0.15 * CASE WHEN ok_openalex THEN {_clip('oa_preprint_share / 0.4')} ELSE 0 END")} + 1e-9, 3) AS emergence,
 {_TOP} AS top, {_WEIGHT} AS weight, {_FULL} AS complete FROM ev),
e2 AS (SELECT *, CASE WHEN NOT complete AND top / 1.1 < 0.6 THEN least(coalesce(top / nullif(weight, 0), 0), 0.59) ELSE coalesce(top / nullif(weight, 0), 0) END AS risk, (ok_wiki AND wiki_article > 0 AND wiki_age >= 5) OR (ok_openalex AND oa_total >= 3000 AND oa_age >= 8) AS known FROM e1),
e3 AS (SELECT *, round({_clip("greatest(CASE WHEN known THEN 1 ELSE risk END, CASE WHEN ok_wiki THEN 0 ELSE 0.5 END)")} + 1e-9, 3) AS maturity,
 CASE WHEN n_documents = 0 THEN 0 ELSE greatest(CASE WHEN syndication_rate >= 0.5 THEN 0.8 ELSE 0 END, CASE WHEN n_supporting > 0 AND n_promo >= 2 * n_supporting THEN 0.7 ELSE 0 END, CASE WHEN n_documents >= 3 AND origin_concentration >= 0.99 AND NOT science_document THEN 0.7 ELSE 0 END) END AS dh FROM e2),
e4 AS (SELECT *, round({_clip("greatest(CASE WHEN ok_news THEN CASE WHEN news_press_share >= 0.5 THEN 0.85 ELSE " + _clip("news_press_share / 0.5") + " * 0.5 END ELSE 0 END, CASE WHEN ok_news AND news_1y >= 30 AND ok_openalex AND oa_total < 10 AND ok_github AND coalesce(gh_total, 0) < 5 THEN 0.75 ELSE 0 END, CASE WHEN ok_openalex AND oa_peak_ratio < 0.5 AND oa_peak_year <= 2023 AND oa_age >= 5 AND oa_total >= 50 THEN 0.8 ELSE 0 END, CASE WHEN ok_openalex AND burst >= 3 AND oa_prior = 0 AND oa_total < 15 THEN 0.65 ELSE 0 END, dh)")} + 1e-9, 3) AS hype,
 round({_clip("([0.0, 0.35, 0.65, 0.85][n_families + 1] + CASE WHEN has_science AND oa_total >= 3 THEN 0.10 ELSE 0 END) * completeness - CASE WHEN ok_wiki THEN 0 ELSE 0.15 END - CASE WHEN stale THEN 0.05 ELSE 0 END")} + 1e-9, 3) AS confidence,
 CASE WHEN n_documents = 0 THEN 'supporting_evidence_not_materialized' WHEN n_supporting = 0 AND n_irrelevant_primary > 0 THEN 'no_claim_relevant_evidence' WHEN n_supporting = 0 THEN 'no_acceptable_source_quality' WHEN independent_supports < 2 OR distinct_origins < 2 THEN 'no_independent_corroboration' END AS gate FROM e3)"""
_CODE = """CASE WHEN noise THEN 'semantic_rejection' WHEN completeness = 0 THEN 'all_adapters_failed' WHEN n_families = 0 AND lead_only THEN 'lead_only_evidence' WHEN n_families < 2 THEN 'insufficient_corroborating_families' WHEN confidence < 0.45 THEN 'low_evidence_confidence' WHEN maturity >= 0.6 THEN 'maturity_veto'
 WHEN gate IS NOT NULL THEN gate WHEN hype >= 0.6 THEN 'hype_veto' WHEN verification <> 'SEMANTICALLY_VERIFIED' THEN 'semantic_verification_pending' WHEN NOT (ok_news OR dh > 0) THEN 'hype_evidence_unavailable' WHEN emergence < 0.15 THEN 'no_measurable_emergence' ELSE 'accepted' END"""
_DEC = f"""{_EV}, dc AS (SELECT *, {_CODE} AS code FROM e4), de AS (SELECT *, CASE WHEN code IN ('semantic_rejection', 'no_measurable_emergence') THEN 'NOISE' WHEN code = 'maturity_veto' THEN 'MATURE' WHEN code = 'hype_veto' THEN 'HYPE' WHEN code = 'accepted' THEN 'ACCEPT' ELSE 'LOW_EVIDENCE' END AS decision FROM dc)"""


@query(f"WITH {_EV} SELECT candidate, emergence::DOUBLE AS emergence, maturity::DOUBLE AS maturity, hype::DOUBLE AS hype, confidence::DOUBLE AS confidence FROM e4")
def evidence_scores(s, d):
    return E.scores(_rows(s, d)).select("candidate", "emergence", "maturity", "hype", "confidence")


@query(f"WITH {_DEC} SELECT candidate, code, decision FROM de")
def decide(s, d):
    return E.decided(E.scores(_rows(s, d))).select("candidate", "code", "decision")


@query(f"""WITH {_DEC} SELECT CASE WHEN decision = 'ACCEPT' THEN 'confirmed' WHEN code IN ('semantic_verification_pending', 'no_independent_corroboration', 'supporting_evidence_not_materialized', 'no_claim_relevant_evidence', 'hype_evidence_unavailable') THEN 'watchlist' WHEN decision = 'LOW_EVIDENCE' THEN 'unverified' ELSE 'rejected' END AS state, count(*)::BIGINT AS n FROM de GROUP BY ALL""")
def terminal_states(s, d):
    return E.decided(E.scores(_rows(s, d))).groupBy(E.terminal_state().alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_DEC}, p AS (SELECT * REPLACE ('SEMANTICALLY_VERIFIED' AS verification, greatest(n_documents, 2) AS n_documents, greatest(n_supporting, 2) AS n_supporting) FROM de WHERE code IN ('supporting_evidence_not_materialized', 'no_acceptable_source_quality', 'no_independent_corroboration', 'no_claim_relevant_evidence', 'semantic_verification_pending')),
q AS (SELECT *, CASE WHEN n_documents = 0 THEN 0 ELSE greatest(CASE WHEN syndication_rate >= 0.5 THEN 0.8 ELSE 0 END, CASE WHEN n_supporting > 0 AND n_promo >= 2 * n_supporting THEN 0.7 ELSE 0 END, CASE WHEN n_documents >= 3 AND origin_concentration >= 0.99 AND NOT science_document THEN 0.7 ELSE 0 END) END AS dh2 FROM p)
SELECT candidate FROM q WHERE NOT (hype >= 0.6) AND (ok_news OR dh2 > 0) AND emergence >= 0.15""")
def enrichment(s, d):
    """Candidates that better documents and a check would turn into accepted ones."""
    return E.enrichable(E.decided(E.scores(_rows(s, d)))).select("candidate")


_OBS = "obs AS (SELECT id % 97 AS candidate, ['openalex', 'github', 'news', 'hn', 'wiki'][1 + id % 5] AS source, id AS seq, ['OK', 'NO_RESULTS', 'ERROR', 'OK'][1 + id * 7 % 4] AS status, ['a', 'b', 'c'][1 + id * 11 % 3] AS metric, (id * 13 % 100)::DOUBLE AS value FROM " + ORDER_IDS + " t)"
_MERGED = f"""{_OBS}, best AS (SELECT candidate, source, arg_max(status, row(CASE status WHEN 'OK' THEN 2 WHEN 'NO_RESULTS' THEN 1 ELSE 0 END, seq)) AS status FROM obs GROUP BY ALL),
last AS (SELECT candidate, source, metric, arg_max(value, seq) AS v FROM obs WHERE status <> 'ERROR' GROUP BY ALL), vals AS (SELECT candidate, source, string_agg(metric || '=' || v::BIGINT::VARCHAR, ',' ORDER BY metric || '=' || v::BIGINT::VARCHAR) AS vs FROM last GROUP BY ALL),
merged AS (SELECT candidate, source, status, CASE WHEN status <> 'ERROR' THEN coalesce(vs, '') END AS values FROM best LEFT JOIN vals USING (candidate, source))"""


def _observations(s, d):
    return ids(s, d).selectExpr("id % 97 AS candidate", "element_at(array('openalex', 'github', 'news', 'hn', 'wiki'), cast(1 + id % 5 AS int)) AS source", "id AS seq", "element_at(array('OK', 'NO_RESULTS', 'ERROR', 'OK'), cast(1 + id * 7 % 4 AS int)) AS status", "element_at(array('a', 'b', 'c'), cast(1 + id * 11 % 3 AS int)) AS metric", "cast(id * 13 % 100 AS double) AS value")


@query(f"WITH {_MERGED} SELECT candidate, source, status, values FROM merged")
def evidence_merge(s, d):
    return E.merged(_observations(s, d))


@query(f"WITH {_MERGED}, f AS (SELECT *, CASE source WHEN 'openalex' THEN 'science' WHEN 'github' THEN 'code' WHEN 'news' THEN 'media' WHEN 'hn' THEN 'community' ELSE 'encyclopedia' END AS family FROM merged) SELECT candidate, round(avg((status <> 'ERROR')::INT), 6) AS completeness, coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (status = 'OK' AND family IN ('science', 'code', 'media')), '') AS corroborating, coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (status = 'OK' AND family = 'community'), '') AS lead_only FROM f GROUP BY ALL")
def evidence_completeness(s, d):
    return E.completeness(E.merged(_observations(s, d))).withColumn("completeness", F.round("completeness", 6))


_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"
_HOSTS = ("https://arxiv.org/abs/", "https://www.reuters.com/a/", "https://www.prnewswire.com/x", "https://shop.example.com/p", "https://mit.edu/r/", "https://codeberg.org/Org", "https://doi.org/10.1145/77.", "https://blog.example.com.tr/", "https://www.vedomosti.ru/n/", "https://europa.eu/")
_KINDS = ("paper", "preprint", "repository", "blog", "other", "press_release")
_FAMS = ("science", "code", "media", "community", "press")
_NAMES = ("Reuters.com", "PR Newswire", "The  Daily", "")
_TITLE_OF = "regexp_replace(html, '(?s)^.*?<title>|</title>.*$', '', 'g')"


def _docs0(dialect: int) -> str:
    host, kind, fam, name = (_pick(x, at)[dialect] for x, at in ((_HOSTS, "page_id"), (_KINDS, "page_id * 7"), (_FAMS, "page_id * 3 + page_id % 2"), (_NAMES, "page_id * 5 + page_id % 3")))
    title = _TITLE_OF if dialect else "regexp_replace(html, '(?s)^.*?<title>|</title>.*$', '')"
    cut = "CAST(page_id % 40 AS STRING)" if not dialect else "(page_id % 40)::VARCHAR"
    return f"page_id AS id, CASE WHEN page_id % 11 = 0 THEN url WHEN page_id % 13 = 0 THEN NULL ELSE concat({host}, {cut}) END AS url, {kind} AS kind, {fam} AS family, {name} AS source_name, CASE WHEN page_id % 4 = 0 THEN concat('The study of item ', {cut}, ' in sets') ELSE {title} END AS title"


_DOCS = f"docs0 AS (SELECT {_docs0(1)} FROM pages)"
_H = r"lower(split_part(regexp_replace(coalesce(url, ''), '^https?://(www\.)?', ''), '/', 1))"
_TIER = f"CASE WHEN regexp_matches(h, '{E.PRESS_HOSTS}') OR regexp_matches(source_name, '{E.PRESS_HOSTS}') OR kind = 'press_release' THEN 'C' WHEN kind IN ('paper', 'patent', 'registry') OR regexp_matches(h, '{E.HIGH_HOSTS}') THEN 'A' WHEN kind = 'preprint' OR regexp_matches(h, '{E.MEDIA_HOSTS}') OR regexp_matches(lower(source_name), '{E.MEDIA_HOSTS}') OR kind = 'repository' THEN 'B' WHEN kind IN ('community', 'blog', 'social', 'aggregator') THEN 'C' ELSE 'U' END"


def _docs(s, d):
    return s.sql(f"SELECT {_docs0(0)} FROM {{pages}}", pages=table(s, d, "pages"))


@query(f"WITH {_DOCS}, h AS (SELECT *, {_H} AS h FROM docs0), t AS (SELECT *, {_TIER} AS tier FROM h) SELECT id, tier, CASE WHEN tier IN ('A', 'B') THEN CASE family WHEN 'science' THEN 'existence,research' WHEN 'code' THEN 'existence,implementation' WHEN 'media' THEN 'existence' ELSE '' END ELSE '' END AS claims FROM t")
def trust_tiers(s, d):
    rows = _docs(s, d).withColumn("tier", E.trust_tier(F.col("url"), F.col("kind"), F.col("source_name")))
    return rows.select("id", "tier", F.array_join(E.claims(F.col("family"), F.col("tier")), ",").alias("claims"))


_TWORDS = f"list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-zа-яё0-9]+'), lambda w: w NOT IN {_in(L.TITLE_STOP)})"
_DOM = f"CASE WHEN array_to_string(l[greatest(len(l) - 1, 1):], '.') IN {_in(L.SUFFIXES)} THEN array_to_string(l[greatest(len(l) - 2, 1):], '.') ELSE array_to_string(l[greatest(len(l) - 1, 1):], '.') END"
_CODE_AT = f"CASE WHEN h IN {_in(L.CODE_HOSTS)} THEN CASE WHEN owner <> '' THEN h || ':' || owner ELSE h END END"
_KEYED = rf"""h AS (SELECT *, {_HOST} AS h, string_split({_HOST}, '.') AS l, array_to_string({_TWORDS}[:10], ' ') AS t, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://[^/?#]+/+([^/?#]+)', 1)) AS owner, nullif(regexp_extract(coalesce(url, ''), '(?i)(?:doi\.org/|^doi:|\b)(10\.[0-9]{{4,9}})/', 1), '') AS reg FROM docs0),
keyed AS (SELECT *, CASE WHEN family IN ('media', 'press', 'aggregator', 'community') AND t <> '' THEN 'syndicated|' || t ELSE concat_ws('|', family, coalesce({_CODE_AT}, CASE WHEN family IN ('science', 'patent') THEN 'doi:' || reg END, nullif({_DOM}, ''), nullif(lower(trim(regexp_replace(source_name, '\s+', ' ', 'g'))), ''), 'unknown-origin'), t) END AS k FROM h)"""


@query(f"WITH {_DOCS}, {_KEYED} SELECT id, k FROM keyed")
def independence_keys(s, d):
    return _docs(s, d).select("id", E.independence_key(F.col("family"), F.col("url"), F.col("title"), F.col("source_name")).alias("k"))


_CLOSE = "(len(a.w) > 0 AND a.w = b.w) OR (len(a.c) >= 4 AND a.c = b.w) OR (len(b.c) >= 4 AND b.c = a.w) OR (least(len(a.w), len(b.w)) >= 4 AND least(len(a.w), len(b.w)) / greatest(len(a.w), len(b.w)) >= 0.75 AND len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.85)"
_CORE = f"CASE WHEN trim(regexp_replace(title, '^[^:—–]*[:—–]?', '')) <> '' THEN list_sort(list_distinct({_TWORDS.replace('title', chr(39).join(['regexp_extract(title, ', '^[^:—–]*', ')']))})) ELSE [] END"
_CLOSURE = "r(n, c) AS (SELECT id, id FROM u UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n), m AS (SELECT n, min(c) AS component FROM r GROUP BY ALL)"
_TITLED = "t AS (SELECT doc_id AS id, array_to_string(string_split(coalesce(text, ''), ' ')[:8], ' ') || CASE doc_id % 7 WHEN 0 THEN ': more of it' WHEN 1 THEN ' – ' ELSE '' END AS title FROM documents)"


@query(f"""WITH RECURSIVE {_TITLED}, u AS (SELECT id, list_sort(list_distinct({_TWORDS})) AS w, {_CORE} AS c FROM t),
e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND ({_CLOSE})), {_CLOSURE} SELECT n AS id, component FROM m""")
def same_work(s, d):
    """Documents whose first words are one title, over versions and subtitles: (id, component)."""
    title = F.concat(F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 8), " "), F.when(F.col("doc_id") % 7 == 0, ": more of it").when(F.col("doc_id") % 7 == 1, " – ").otherwise(""))
    none = F.lit(None).cast("string")
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("science").alias("family"), none.alias("url"), none.alias("doi"), X.work_tokens(title).alias("tokens"), X.title_core(title).alias("core"))
    found = connected_components(E.same_work(rows), "a", "b").withColumnRenamed("node", "id")
    return rows.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query(f"""WITH RECURSIVE {_DOCS}, {_KEYED}, ranked AS (SELECT keyed.*, CASE {_TIER.replace('(h,', '(' + _H + ',')} WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END AS tr FROM keyed),
once AS (SELECT arg_min(id, row(tr, id)) AS doc, min(tr) AS tr, min(id) AS id FROM ranked GROUP BY k), o AS (SELECT once.*, x.family, x.url, x.title FROM once JOIN docs0 x ON x.id = once.doc),
u AS (SELECT id, family, nullif(url, '') AS url, nullif(regexp_replace(lower(regexp_extract(coalesce(url, ''), '(?i)(?:doi\\.org/|^doi:|\\b)(10\\.[0-9]{{4,9}}/[^\\s?#]+)', 1)), '\\.+$', ''), '') AS doi, list_sort(list_distinct({_TWORDS})) AS w, {_CORE} AS c FROM o),
e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND a.family = b.family AND a.family IN ('science', 'patent') AND (coalesce(a.url = b.url, false) OR coalesce(a.doi = b.doi, false) OR ({_CLOSE}))), {_CLOSURE}
SELECT arg_min(doc, row(tr, id)) AS id FROM o JOIN m ON m.n = o.id GROUP BY component""")
def independent_documents(s, d):
    """One document for each piece of independent evidence: the best tier, then the earliest."""
    rows = _docs(s, d).withColumn("tier", E.trust_tier(F.col("url"), F.col("kind"), F.col("source_name")))
    return E.independent_documents(rows.select("id", "family", "url", "title", "source_name", "tier")).select("id")


_RK = "rk AS (SELECT id, CASE WHEN id % 3 <> 0 THEN (id * 7 % 100) / 100.0 END AS expert_p_axes, CASE WHEN id % 5 <> 0 THEN (id * 11 % 100) / 100.0 END AS history_p_axes, CASE WHEN id % 7 <> 0 THEN (id * 13 % 100) / 100.0 END AS expert, CASE WHEN id % 4 <> 0 THEN (id * 17 % 60) / 10.0 END AS incremental_lex, ['protocol', 'composite', 'term'][1 + id % 3] AS kind, ['G', 'M', 'T', 'K'][1 + id % 4] AS verdict, (id * 19 % 83) / 83.0 AS relevance, CASE WHEN id % 6 <> 0 THEN 2012 + id % 15 END AS first_year, CASE WHEN id % 8 <> 0 THEN (id * 23 % 50) / 10.0 - 2 END AS stage_accel, id % 2 = 0 AS layer_only_science, (id * 29 % 70) / 100.0 AS doc_novelty_mean FROM " + ORDER_IDS + " t)"
_WEAK = "CASE WHEN expert_p_axes IS NULL AND expert IS NULL THEN 0 ELSE least(greatest(CASE WHEN expert_p_axes IS NOT NULL AND history_p_axes IS NOT NULL THEN 0.7 * expert_p_axes + 0.3 * history_p_axes WHEN expert_p_axes IS NOT NULL THEN expert_p_axes ELSE expert END - CASE WHEN coalesce(incremental_lex >= 3, false) OR kind = 'composite' THEN 0.15 ELSE 0 END - CASE WHEN verdict = 'G' THEN 0.35 ELSE 0 END, 0), 1) END"


def _ranked(s, d):
    x = _RK[len("rk AS (SELECT ") : -len(" FROM " + ORDER_IDS + " t)")]
    for a in ("['protocol', 'composite', 'term'][1 + id % 3]", "['G', 'M', 'T', 'K'][1 + id % 4]"):
        inner, at = a[1:].split("][")
        x = x.replace(a, f"element_at(array({inner}), cast({at[:-1]} AS int))")
    rows = s.sql(f"SELECT {x} FROM {{ids}}", ids=ids(s, d))
    return rows.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in rows.dtypes])


@query(f"WITH {_RK} SELECT id, round({_WEAK}, 6)::DOUBLE AS weakness FROM rk")
def weakness_v2(s, d):
    return _ranked(s, d).select("id", F.round(R.weakness(), 6).alias("weakness"))


@query(f"WITH {_RK}, p AS (SELECT *, (rank() OVER (ORDER BY relevance) + (count(*) OVER (PARTITION BY relevance) - 1) / 2) / count(*) OVER () AS pct, {_WEAK} AS w FROM rk) SELECT id, round(pct * w, 6)::DOUBLE AS \"order\" FROM p")
def order_v2(s, d):
    return R.ordered(_ranked(s, d)).select("id", F.round("order", 6).alias("order"))


@query(f"WITH {_RK}, p AS (SELECT id, (rank() OVER (ORDER BY relevance) + (count(*) OVER (PARTITION BY relevance) - 1) / 2) / count(*) OVER () AS pct, coalesce(expert, 0) AS e, 1 + id % 3 AS tier FROM rk) SELECT id, round(0.5 * pct + 0.5 * e - (tier - 1), 6)::DOUBLE AS \"order\" FROM p")
def order_v1(s, d):
    rows = R.percentile_ranked(_ranked(s, d), "relevance")
    return rows.select("id", F.round(0.5 * F.col("pct") + 0.5 * F.coalesce("expert", F.lit(0.0)) - (F.col("id") % 3), 6).alias("order"))


@query(f"WITH {_PH}, j AS (SELECT phrase, ['protocol', 'composite', 'term'][1 + length(phrase) % 3] AS kind, CASE WHEN length(phrase) % 6 <> 0 THEN 2012 + length(phrase) * 7 % 15 END AS first_year, ['G', 'M', 'T', 'K'][1 + length(phrase) % 4] AS verdict FROM ph) SELECT phrase, CASE WHEN regexp_matches(trim(replace(phrase, '_', ' ')), '(?i)(?:{_XSTD})\\s*$') OR (kind = 'protocol' AND regexp_matches(replace(phrase, '_', ' '), '(?i){_XSTD}')) THEN 'standard' WHEN first_year <= 2019 THEN 'mature' WHEN verdict = 'M' THEN 'mature_review' END AS code FROM j")
def exclusion_reason(s, d):
    n = F.length("phrase")
    of = lambda *v: F.array(*[F.lit(x) for x in v])
    rows = _phrases(s, d).select("phrase", of("protocol", "composite", "term")[n % 3].alias("kind"), F.when(n % 6 != 0, 2012 + n * 7 % 15).alias("first_year"), of("G", "M", "T", "K")[n % 4].alias("verdict"))
    return rows.select("phrase", R.exclusion().alias("code"))


@query(f"WITH {_RK} SELECT id, round(CASE WHEN incremental_lex IS NOT NULL THEN least(greatest(incremental_lex / 6, 0), 1) END, 3)::DOUBLE AS incremental, round(1 / (1 + exp(-stage_accel)), 3)::DOUBLE AS stage_early, layer_only_science::INT::DOUBLE AS layer_early, round(least(greatest(doc_novelty_mean / 0.5, 0), 1), 3)::DOUBLE AS novelty FROM rk")
def axes_view(s, d):
    return R.axes_view(_ranked(s, d)).select("id", "incremental", "stage_early", "layer_early", "novelty")


_XS, _YS = [0.0, 0.2, 0.5, 0.8, 1.0], [0.02, 0.1, 0.25, 0.6, 0.9]
_INTERP = "CASE WHEN x <= 0 THEN 0.02 " + " ".join(f"WHEN x <= {b} THEN {p} + (x - {a}) * {(q - p) / (b - a)!r}" for a, b, p, q in zip(_XS, _XS[1:], _YS, _YS[1:])) + " WHEN x IS NOT NULL THEN 0.9 END"


@query(f"WITH {_RK}, c AS (SELECT id, expert_p_axes::DOUBLE AS x FROM rk), i AS (SELECT id, ({_INTERP})::DOUBLE AS y FROM c) SELECT id, round(y, 6) AS calibrated, round(round(y / 0.05, 0) * 0.05, 2) AS confidence FROM i")
def calibration_interp(s, d):
    p = F.col("expert_p_axes")
    return _ranked(s, d).select("id", F.round(R.interpolated(p, _XS, _YS), 6).alias("calibrated"), R.confidence(p, _XS, _YS).alias("confidence"))


@query(f"WITH {_PH}, w AS (SELECT phrase, string_split(phrase, ' ') AS w FROM ph), y AS (SELECT a.phrase AS p, b.phrase AS q, a.w AS a, b.w AS b, length(a.phrase || b.phrase) % 20 / 20.0 AS s FROM w a JOIN w b ON a.phrase < b.phrase AND len(list_intersect(a.w, b.w)) > 0), z AS (SELECT *, len(list_intersect(a, b)) AS k FROM y) SELECT p, q FROM z WHERE len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 OR (k * 3 >= 2 * greatest(len(a), len(b)) AND a[len(a)] = b[len(b)]) OR s >= 0.8")
def duplicate_rule(s, d):
    x = _phrases(s, d).select("phrase", F.split("phrase", " ").alias("w"), F.explode(F.array_distinct(F.split("phrase", " "))).alias("k"))
    both = x.toDF("p", "a", "k").join(x.toDF("q", "b", "k"), "k").where("p < q").drop("k").distinct()
    return both.where(R.is_duplicate(F.col("a"), F.col("b"), F.length(F.concat("p", "q")) % 20 / 20.0)).select("p", "q")


@query("WITH r AS (SELECT id, id * 7 % 50 AS b, id * 3 % 40 AS lit, id % 9 AS repo, id % 5 AS pre, id % 4 AS news FROM (SELECT c_custkey AS id FROM customer) t), f AS (SELECT *, (lit > 0)::INT + (repo > 0)::INT + (pre > 0)::INT + (news > 0)::INT AS families FROM r) SELECT id, round((b / 10.0 * ln(1 + lit) + 1.2 * ln(1 + repo) + 0.8 * ln(1 + pre) + 0.5 * ln(1 + news)) * (1 + 0.5 * (families - 1)), 6)::DOUBLE AS score FROM f")
def candidate_score(s, d):
    r = ids(s, d, "customer", "c_custkey").selectExpr("id", "cast(id * 7 % 50 AS double) AS b", "cast(id * 3 % 40 AS double) AS lit", "cast(id % 9 AS double) AS repo", "cast(id % 5 AS double) AS pre", "cast(id % 4 AS double) AS news")
    families = sum(((F.col(c) > 0).cast("int") for c in ("lit", "repo", "pre", "news")), F.lit(0))
    base = F.col("b") / 10 * F.log1p("lit") + 1.2 * F.log1p("repo") + 0.8 * F.log1p("pre") + 0.5 * F.log1p("news")
    return r.select("id", F.round(base * (1 + 0.5 * (families - 1)), 6).alias("score"))


@query("WITH r AS (SELECT id, (id * 7 % 60) / 10.0 - 2 AS growth, id % 12 AS age, id * 37 % 4000 AS n, id % 30 AS repos FROM (SELECT c_custkey AS id FROM customer) t) SELECT id, round(1.5 * greatest(growth, 0) - 0.25 * age - 0.4 * abs(ln(1 + n) - ln(151)) + 0.8 * ln(1 + repos) + 0.5 * (n > 0 AND n < 3000)::INT, 6)::DOUBLE AS score FROM r")
def novelty_score(s, d):
    r = ids(s, d, "customer", "c_custkey").selectExpr("id", "cast(id * 7 % 60 AS double) / 10 - 2 AS growth", "cast(id % 12 AS double) AS age", "cast(id * 37 % 4000 AS double) AS n", "cast(id % 30 AS double) AS repos")
    n = F.col("n")
    return r.select("id", F.round(1.5 * F.greatest("growth", F.lit(0.0)) - 0.25 * F.col("age") - 0.4 * F.abs(F.log1p(n) - F.log1p(F.lit(150.0))) + 0.8 * F.log1p("repos") + 0.5 * ((n > 0) & (n < 3000)).cast("int"), 6).alias("score"))


@query("WITH c AS (SELECT c_nationkey AS k, list(round(c_acctbal)::BIGINT % 100 ORDER BY c_custkey)[:12] AS v FROM customer WHERE c_acctbal > 0 GROUP BY ALL) SELECT k, array_to_string(list_transform(v, lambda x: '▁▂▃▄▅▆▇█'[1 + least(7, coalesce(floor(x / nullif(list_max(v), 0) * 7.999), 0)::INT)]), '') AS line FROM c")
def sparklines(s, d):
    c = table(s, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", (F.round("c_acctbal").cast("long") % 100).alias("v")))).alias("v"))
    return c.select("k", X.sparkline(F.slice(F.transform("v", lambda x: x["v"]), 1, 12)).alias("line"))


@query("WITH r AS (SELECT id, ['lab', 'lab → pilot', 'pilot/market', 'market', 'unknown', 'lab -> market'][1 + id % 6] AS t FROM (SELECT c_custkey AS id FROM customer) x) SELECT id, CASE id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 WHEN 3 THEN 2.0 WHEN 5 THEN 1.0 END::DOUBLE AS stage FROM r")
def stage_ordinals(s, d):
    t = ids(s, d, "customer", "c_custkey").selectExpr("id", "element_at(array('lab', 'lab → pilot', 'pilot/market', 'market', 'unknown', 'lab -> market'), cast(1 + id % 6 AS int)) AS t")
    return t.select("id", X.stage_ordinal(F.col("t"), ("lab", "pilot", "market")).alias("stage"))
