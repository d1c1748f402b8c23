"""Queries over texts and URLs: term extraction, vocabularies, keys, name rules, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.functions import lexicon as L
from glimmer.functions import text as X
from glimmer.functions import urls as U
from glimmer.operators import cube, pairs, rank
from glimmer.plans.panels import TEXT_SQL, query, table, text_docs


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


_B = _in(L.BOUNDARY)
_NORM = rf"""norm AS (SELECT *, array_to_string(list_transform(regexp_extract_all(replace(lower(coalesce(text, '')), '_', ' '), '[a-z0-9]+(?:-[a-z0-9]+)*|[^a-z0-9]+'),
  lambda x: CASE WHEN regexp_matches(x, '^[a-z0-9]+-') THEN CASE WHEN len(list_filter(list_slice(string_split(x, '-'), 2, len(string_split(x, '-')) - 1), lambda p: p IN {_B})) > 0 THEN replace(x, '-', '_') ELSE replace(x, '-', ' ') END ELSE x END), '') AS t FROM tdocs)"""
_BREAK = L.PIECE_BREAK.replace("'", "''")
_CHUNKS = rf"""{_NORM}, pieces AS (SELECT doc_id, year, lang, source, text, unnest(regexp_split_to_array(t, '{_BREAK}')) AS p, unnest(range(len(regexp_split_to_array(t, '{_BREAK}')))) AS pi FROM norm),
toks AS (SELECT doc_id, pi, unnest(regexp_extract_all(p, '{L.TOKEN}')) AS tok, unnest(range(len(regexp_extract_all(p, '{L.TOKEN}')))) AS i FROM pieces),
flag AS (SELECT *, tok IN {_B} AS bound, regexp_full_match(replace(tok, '.', ''), '[0-9]+') AS num FROM toks),
cut AS (SELECT *, bound OR (num AND (coalesce(lag(bound OR num) OVER w, true) OR regexp_full_match(tok, '(19|20)[0-9][0-9]'))) AS c FROM flag WINDOW w AS (PARTITION BY doc_id, pi ORDER BY i)),
run AS (SELECT *, sum(c::INT) OVER (PARTITION BY doc_id, pi ORDER BY i) AS r FROM cut),
chunks AS (SELECT doc_id, list(tok ORDER BY i) AS ch FROM run WHERE NOT c GROUP BY doc_id, pi, r),
gn AS (SELECT doc_id, ch, unnest([2, 3, 4]) AS n FROM chunks), gi AS (SELECT doc_id, ch, n, unnest(range(1, len(ch) - n + 2)) AS i FROM gn WHERE len(ch) >= n),
g AS (SELECT doc_id, ch[i:i + n - 1] AS g FROM gi),
grams AS (SELECT doc_id, array_to_string(g, ' ') AS phrase FROM g WHERE g[1] NOT IN {_in(L.START_BAD)} AND g[len(g)] NOT IN {_in(L.END_BAD)} AND NOT regexp_full_match(g[1], '[0-9]+') AND length(g[1]) >= 2 AND length(g[len(g)]) >= 2),
unis AS (SELECT doc_id, tok AS phrase FROM run WHERE NOT c AND ((regexp_full_match(tok, '[a-z0-9]{{2,12}}') AND regexp_matches(tok, '[a-z]') AND regexp_matches(tok, '[0-9]')) OR contains(tok, '_'))),
acr AS (SELECT doc_id, lower(unnest(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+'), lambda r: regexp_matches(r, '{L.ACRONYM}')))) AS phrase FROM tdocs),
cand AS (SELECT doc_id, phrase FROM grams UNION SELECT doc_id, phrase FROM unis UNION SELECT doc_id, phrase FROM acr WHERE length(phrase) >= 3 AND phrase NOT IN {_B})"""
_STEM = r"""CASE WHEN contains(w, '_') THEN w WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:length(w) - 3] || 'y' WHEN length(w) > 4 AND w LIKE '%sses' THEN w[:length(w) - 2]
  WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is' OR w LIKE '%ics') THEN w[:length(w) - 1] ELSE w END"""
_KEY = f"array_to_string(list_sort(list_distinct(list_transform(string_split(phrase, ' '), lambda w: {_STEM}))), ' ')"
_VOCAB = f"{TEXT_SQL}, {_CHUNKS}, vocab AS (SELECT phrase, count(*) AS df FROM cand GROUP BY ALL HAVING count(*) >= 3)"


@query(f"WITH {TEXT_SQL}, {_CHUNKS} SELECT doc_id, count(*)::BIGINT AS n, min(phrase) AS first, max(phrase) AS last, sum(length(phrase))::BIGINT AS chars FROM cand GROUP BY ALL")
def doc_candidates(s, d):
    rows = text_docs(s, d).select("doc_id", F.explode(X.candidates(F.col("text"))).alias("phrase"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("first"), F.max("phrase").alias("last"), F.sum(F.length("phrase")).alias("chars"))


def _vocab(s, d):
    return cube.vocabulary(text_docs(s, d), X.candidates(F.col("text")))


@query(f"WITH {_VOCAB} SELECT phrase, df::BIGINT AS df FROM vocab")
def vocab_df3(s, d):
    return _vocab(s, d)


@query(f"WITH {_VOCAB}, k AS (SELECT *, {_KEY} AS entity_key FROM vocab) SELECT entity_key, arg_min(phrase, row(-df, phrase)) AS name, sum(df)::BIGINT AS df, count(*)::BIGINT AS n_variants FROM k GROUP BY ALL")
def entity_fold(s, d):
    return cube.entity_fold(_vocab(s, d))


@query(f"WITH {_VOCAB}, k AS (SELECT phrase, {_KEY} AS entity FROM vocab), m AS (SELECT DISTINCT doc_id, source, year, entity FROM cand JOIN k USING (phrase) JOIN tdocs USING (doc_id)) SELECT entity, source, year, count(*)::BIGINT AS df FROM m GROUP BY ALL")
def term_cube(s, d):
    found = cube.mentions(text_docs(s, d), X.candidates(F.col("text")), _vocab(s, d), ("doc_id", "source", "year"))
    return cube.count_cube(found.withColumnRenamed("entity_key", "entity"), once=True)


@query(f"WITH {_VOCAB}, c AS (SELECT phrase, lang AS source, count(*) AS df FROM cand JOIN tdocs USING (doc_id) GROUP BY ALL) SELECT phrase, sum(df)::BIGINT AS df, count(*)::BIGINT AS n_sources FROM c GROUP BY phrase HAVING bool_or(df >= CASE source WHEN 'es' THEN 2 ELSE 3 END)")
def any_source_vocab(s, d):
    rows = text_docs(s, d).select("lang", F.explode(X.candidates(F.col("text"))).alias("phrase"))
    counts = rows.groupBy("phrase", F.col("lang").alias("source")).agg(F.count(F.lit(1)).alias("df"))
    return cube.any_source_vocabulary(counts, {"es": 2})


@query(f"WITH {_VOCAB}, w AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS w, df FROM vocab), f AS (SELECT w, sum(df) AS n FROM w GROUP BY ALL) SELECT phrase, round(log10(min(n)), 6) AS specificity FROM w JOIN f USING (w) GROUP BY ALL")
def specificity(s, d):
    w = _vocab(s, d).select("phrase", F.explode(F.split("phrase", " ")).alias("w"), "df")
    return w.join(w.groupBy("w").agg(F.sum("df").alias("n")), "w").groupBy("phrase").agg(F.round(F.log10(F.min("n")), 6).alias("specificity"))


_SIMPLE = rf"simple AS (SELECT doc_id, lang, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}\-]+'), lambda w: regexp_full_match(w, '[a-z][a-z0-9\-]{{2,}}') AND w NOT IN {_B})) AS term FROM tdocs)"


@query(f"WITH {TEXT_SQL}, {_SIMPLE}, t AS (SELECT lang AS cluster, term, count(*) AS tf FROM simple GROUP BY ALL), l AS (SELECT cluster, sum(tf) AS l FROM t GROUP BY ALL), f AS (SELECT term, sum(tf) AS f FROM t GROUP BY ALL), w AS (SELECT cluster, term, tf / l * ln(1 + (SELECT avg(l) FROM l) / f) AS weight FROM t JOIN l USING (cluster) JOIN f USING (term)) SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 9) DESC, term)::INT AS rank, term, round(weight, 6) AS weight FROM w QUALIFY rank <= 6")
def ctfidf_top(s, d):
    terms = text_docs(s, d).select(F.col("lang").alias("cluster"), F.explode(X.simple_tokens(F.col("text"))).alias("term")).groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("tf"))
    return pairs.ctfidf(terms).withColumn("weight", F.round("weight", 6))


@query(f"WITH {TEXT_SQL}, {_SIMPLE}, u AS (SELECT DISTINCT doc_id, lang, term FROM simple), q AS (SELECT term AS phrase, count(*) AS dfq FROM u WHERE lang = 'de' GROUP BY ALL), b AS (SELECT term AS phrase, count(*) AS dfb FROM u WHERE lang <> 'de' GROUP BY ALL), n AS (SELECT count(*) FILTER (lang = 'de') AS nq, count(*) FILTER (lang <> 'de') AS nb FROM tdocs) SELECT phrase, dfq::BIGINT AS dfq, coalesce(dfb, 0)::BIGINT AS dfb, round(ln((dfq / nullif(nq, 0) + 1e-4) / (coalesce(dfb, 0) / nullif(nb, 0) + 1e-4)), 6) AS keyness FROM q LEFT JOIN b USING (phrase), n")
def keyness(s, d):
    docs = text_docs(s, d)
    n = docs.agg(F.count_if(F.col("lang") == "de").alias("nq"), F.count_if(F.col("lang") != "de").alias("nb"))
    u = docs.select("lang", F.explode(F.array_distinct(X.simple_tokens(F.col("text")))).alias("phrase"))
    q = u.where("lang = 'de'").groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))
    b = u.where("lang <> 'de'").groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    n1 = n.first()
    return pairs.keyness(q, b, n1["nq"], n1["nb"]).withColumn("keyness", F.round("keyness", 6))


@query(f"WITH {TEXT_SQL}, {_SIMPLE}, u AS (SELECT DISTINCT doc_id, term FROM simple) SELECT term AS phrase, count(*)::BIGINT AS df FROM u GROUP BY ALL HAVING count(*) / (SELECT count(*) FROM tdocs) >= 0.004 AND count(*) >= 2")
def cliches(s, d):
    docs = text_docs(s, d)
    n = max(1, docs.count())
    return docs.select(F.explode(F.array_distinct(X.simple_tokens(F.col("text")))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") / n >= 0.004) & (F.col("df") >= 2))


_MO = {"methods": {"the_of": r"\bof the\b", "and_the": r"\band the\b", "was": r"\bwas\b"}, "objects": {"with": r"\bwith\b", "that": r"\bthat\b", "from": r"\bfrom\b"}}


def _mo(k, col):
    return "[" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _MO[k].items()) + f"] AS {col}"


@query(rf"""WITH {TEXT_SQL}, x AS (SELECT doc_id, year, {_mo('methods', 'm')}, {_mo('objects', 'o')} FROM tdocs), c AS (SELECT doc_id, year, m AS method, unnest(o) AS object FROM (SELECT doc_id, year, o, unnest(m) AS m FROM x)),
c2 AS (SELECT * FROM c WHERE method IS NOT NULL AND object IS NOT NULL), yr AS (SELECT method, object, year, count(*) AS n FROM c2 GROUP BY ALL), n AS (SELECT count(*) FILTER (year BETWEEN 2024 AND 2026) AS nr, count(*) FILTER (year BETWEEN 2019 AND 2022) AS nb FROM tdocs),
e AS (SELECT method, object, string_agg(doc_id::VARCHAR, ',' ORDER BY year DESC, doc_id) AS examples FROM (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY method, object ORDER BY year DESC, doc_id) <= 8) GROUP BY ALL)
SELECT method, object, coalesce(sum(yr.n) FILTER (year BETWEEN 2024 AND 2026), 0)::BIGINT AS r, coalesce(sum(yr.n) FILTER (year BETWEEN 2019 AND 2022), 0)::BIGINT AS base,
 round(log2((coalesce(sum(yr.n) FILTER (year BETWEEN 2024 AND 2026), 0) / nullif(any_value(nr), 0) + 1e-9) / (coalesce(sum(yr.n) FILTER (year BETWEEN 2019 AND 2022), 0) / nullif(any_value(nb), 0) + 1e-9)), 6) AS growth, min(year) FILTER (yr.n >= 3)::INT AS first_year, any_value(examples) AS examples FROM yr JOIN e USING (method, object), n GROUP BY method, object""")
def method_object_cross(s, d):
    from glimmer.operators.windows import Params

    docs = text_docs(s, d).select("doc_id", "year", "text")
    found = pairs.cross(docs, _MO["methods"], _MO["objects"])
    return pairs.cross_series(found, docs.groupBy("year").agg(F.count(F.lit(1)).alias("n")), Params()).withColumn("growth", F.round("growth", 6))


@query(f"WITH {TEXT_SQL}, n AS (SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(coalesce(split_part(text, chr(10), 1), '')), '[a-zа-яё0-9]+'), lambda w: w NOT IN {_in(L.TITLE_STOP)})[:10], ' ') AS t FROM tdocs) SELECT t AS title, min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM n GROUP BY ALL")
def title_dedup(s, d):
    t = X.normalized_title(F.split("text", "\n")[0])
    return text_docs(s, d).select("doc_id", t.alias("title")).groupBy("title").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def domain_merge(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, substr(sha256(concat_ws(chr(10), lang, source, substr(text, 1, 500))), 1, 32) AS hash FROM documents")
def content_hashes(s, d):
    return table(s, d, "documents").select("doc_id", X.content_hash(F.col("lang"), F.col("source"), F.col("text")).alias("hash"))


@query("WITH w AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^a-z ]', '', 'g'), ' ')) AS w, unnest(range(len(string_split(regexp_replace(text, '[^a-z ]', '', 'g'), ' ')))) AS i FROM documents WHERE lang = 'en'), m AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w GROUP BY ALL) SELECT doc_id, md5(t) AS digest FROM m")
def inverted_index_rebuild(s, d):
    """Texts taken apart into word -> places and put together again."""
    docs = table(s, d, "documents").where("lang = 'en'").select("doc_id", F.split(F.regexp_replace("text", "[^a-z ]", ""), " ").alias("ws"))
    places = docs.select("doc_id", F.posexplode("ws").alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    index = places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", F.md5(X.rebuilt_abstract(F.col("index")).cast("binary")).alias("digest"))


_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"
_AT = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"


@query(rf"""WITH p AS (SELECT page_id, coalesce(url, '') AS u, regexp_replace(coalesce(url, ''), '#.*$', '') AS p FROM pages),
q AS (SELECT *, lower(regexp_extract(p, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(p, '{_AT}([^/?]*)', 1)), '^www\.', '') AS net, regexp_replace(regexp_extract(p, '{_AT}[^/?]*([^?]*)', 1), '/+$', '') AS path,
 list_transform(list_filter(string_split(regexp_extract(p, '\?(.*)$', 1), '&'), lambda x: x <> ''), lambda x: [url_decode(replace(split_part(x, '=', 1), '+', ' ')), url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) ELSE '' END, '+', ' '))]) AS kv FROM p),
k AS (SELECT *, array_to_string(list_transform(list_filter(kv, lambda x: NOT regexp_matches(lower(x[1]), '{L.TRACKING}')), lambda x: replace(url_encode(x[1]), '%20', '+') || '=' || replace(url_encode(x[2]), '%20', '+')), '&') AS asked FROM q)
SELECT page_id, CASE WHEN regexp_matches(lower(u), '^(10\.|doi:)') THEN 'https://doi.org/' || ltrim(CASE WHEN contains(u, ':') THEN substr(u, instr(u, ':') + 1) ELSE u END, '/') WHEN scheme <> '' AND net <> '' AND net NOT IN {_in(L.REDIRECTS)} THEN scheme || '://' || net || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END END AS url FROM k""")
def canonical_urls(s, d):
    return table(s, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))


_DOMAIN = f"CASE WHEN array_to_string(l[greatest(len(l) - 1, 1):], '.') IN {_in(L.SUFFIXES)} THEN array_to_string(l[greatest(len(l) - 2, 1):], '.') ELSE array_to_string(l[greatest(len(l) - 1, 1):], '.') END"


@query(f"WITH p AS (SELECT page_id, string_split({_HOST}, '.') AS l FROM pages) SELECT page_id, {_DOMAIN} AS domain FROM p")
def registrable_domains(s, d):
    return table(s, d, "pages").select("page_id", U.registrable_domain(F.col("url")).alias("domain"))


@query(f"WITH p AS (SELECT page_id, string_split({_HOST}, '.') AS l, regexp_replace(html, '(?s)^.*?<title>|</title>.*$', '', 'g') AS t FROM pages), q AS (SELECT {_DOMAIN} AS origin, length(t) % 50 AS k, page_id % 5 AS grp FROM p), o AS (SELECT grp, origin, count(*) AS c FROM q GROUP BY ALL), m AS (SELECT grp, max(c) / sum(c) AS oc FROM o GROUP BY ALL) SELECT grp::BIGINT AS grp, count(*)::BIGINT AS n, round(1 - count(DISTINCT k) / count(*), 6) AS syndication_rate, round(any_value(oc), 6) AS origin_concentration FROM q JOIN m USING (grp) GROUP BY grp")
def page_concentration(s, d):
    from glimmer.operators import evidence

    title = F.regexp_replace("html", "(?s)^.*?<title>|</title>.*$", "")
    rows = table(s, d, "pages").select((F.col("page_id") % 5).alias("grp"), (F.length(title) % 50).alias("title_key"), U.registrable_domain(F.col("url")).alias("origin"))
    return evidence.concentration(rows, "grp").select("grp", "n", F.round("syndication_rate", 6).alias("syndication_rate"), F.round("origin_concentration", 6).alias("origin_concentration"))


_LEGAL = ", ['Inc.', 'GmbH', 'L.L.C.', 'PBC', 'Holdings Corp.', 'Group'][1 + s_suppkey % 6]"


@query(rf"SELECT s_suppkey, array_to_string(regexp_extract_all(regexp_replace(lower(concat_ws(', ', s_name{_LEGAL})), '{L.LEGAL_FORMS}', ' ', 'g'), '[a-z0-9]+'), ' ') AS name FROM supplier")
def company_names(s, d):
    form = F.array(*[F.lit(x) for x in ("Inc.", "GmbH", "L.L.C.", "PBC", "Holdings Corp.", "Group")])[(F.col("s_suppkey") % 6).cast("int")]
    return table(s, d, "supplier").select("s_suppkey", X.company_name(F.concat_ws(", ", "s_name", form)).alias("name"))


_NAMES3 = "n AS (SELECT DISTINCT lower(p_type) || ' ' || lower(p_name) AS p FROM part), x AS (SELECT p, string_split(p, ' ') AS w FROM n)"


def _names3(s, d):
    return table(s, d, "part").select(F.concat_ws(" ", F.lower("p_type"), F.lower("p_name")).alias("p")).distinct().select("p", F.split("p", " ").alias("w"))


@query(f"WITH {_NAMES3}, y AS (SELECT a.p AS a, b.p AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j FROM x a JOIN x b ON a.p < b.p) SELECT a, b, round(j, 6) AS jaccard FROM y WHERE j >= 0.34")
def jaccard_pairs(s, d):
    """Phrases meet over a shared word."""
    x = _names3(s, d).withColumn("k", F.explode(F.array_distinct("w")))
    both = x.toDF("a", "wa", "k").join(x.toDF("b", "wb", "k"), "k").where("a < b").select("a", "b", rank.jaccard(F.col("wa"), F.col("wb")).alias("j")).distinct()
    return both.where("j >= 0.34").select("a", "b", F.round("j", 6).alias("jaccard"))


_NAMES = "n AS (SELECT DISTINCT lower(p_name) AS p FROM part)"


@query(f"WITH {_NAMES}, x AS (SELECT p, string_split(p, ' ') AS w FROM n), y AS (SELECT a.p AS p, b.p AS q, a.w AS a, b.w AS b FROM x a JOIN x b ON a.p <> b.p AND len(list_intersect(a.w, b.w)) > 0) SELECT p, q, (len(list_filter(a, lambda i: NOT list_contains(b, i))) = 0 AND len(a) >= greatest(2, ceil(0.6 * len(b)))) OR len(list_filter(b, lambda i: NOT list_contains(a, i))) = 0 AS covers FROM y")
def covers_rule(s, d):
    x = table(s, d, "part").select(F.lower("p_name").alias("p")).distinct().select("p", F.split("p", " ").alias("w"), F.explode(F.array_distinct(F.split("p", " "))).alias("k"))
    both = x.toDF("p", "a", "k").join(x.toDF("q", "b", "k"), "k").where("p <> q").select("p", "q", "a", "b").distinct()
    return both.select("p", "q", rank.covers(F.col("a"), F.col("b")).alias("covers"))
