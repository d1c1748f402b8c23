"""Queries over leaders and second lists, merged cards, claims, first-generation features and cards, business, industry."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.functions import text as X
from glimmer.operators import base, claims, cube, early, grouping, score
from glimmer.plans.more import _cube
from glimmer.plans.panels import TRADE, TRADE_SQL, ids, query, table, trade_found, trade_names, trade_totals
from glimmer.plans.rules import _PH, _phrases
from glimmer.plans.terms import _in

# Phrases in an order; those that hold one another conflict.
_RANKED = f"{_PH}, k AS (SELECT phrase, -(length(phrase) * 7 % 13) AS rank FROM ph), walk AS (SELECT list([phrase] ORDER BY rank, phrase) AS l FROM k)"
_HOLDS = "(contains(replace(k[1], '-', ' '), replace(x[1], '-', ' ')) OR contains(replace(x[1], '-', ' '), replace(k[1], '-', ' ')))"
_WALK = f"list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_HOLDS})) > 0 THEN acc ELSE list_concat(acc, [x]) END, [])"
_WALK = _WALK.replace("list_reduce(l, lambda acc, x:", "list_reduce(list_transform(l, lambda y: [y]), lambda acc, z:").replace("k[1]", "k[1]").replace("x[1]", "z[1][1]").replace("list_concat(acc, [x])", "list_concat(acc, z)")


def _walked(s, d):
    items = _phrases(s, d).select(F.col("phrase").alias("id"), (-(F.length("phrase") * 7 % 13)).alias("rank"))
    return items, grouping.contained(_phrases(s, d))


@query(f"WITH {_RANKED}, w AS (SELECT {_WALK}[:200] AS kept FROM walk) SELECT unnest(kept)[1] AS phrase FROM w")
def contained_dedup(s, d):
    """Phrases by rank, without those that hold or are held by one taken before; the first 200."""
    items, conflicts = _walked(s, d)
    kept = grouping.greedy_kept(items, conflicts).where("kept").select("id")
    return items.join(kept, "id").orderBy("rank", "id").limit(200).select(F.col("id").alias("phrase"))


@query(f"WITH {_RANKED}, w AS (SELECT {_WALK} AS kept FROM walk) SELECT phrase, list_filter(kept, lambda k: {_HOLDS.replace('x[1]', 'phrase')})[1][1] AS leader FROM k, w")
def grouped_phrases(s, d):
    """Phrases with the leader they belong to."""
    return grouping.grouped(*_walked(s, d)).select(F.col("id").alias("phrase"), "leader")


@query(f"WITH {_RANKED}, f AS (SELECT l[:20] AS shown, l FROM walk), w AS (SELECT len(shown) AS n, list_reduce(list_concat([shown], list_transform(list_filter(l, lambda y: NOT list_contains(shown, y)), lambda y: [y])), lambda acc, z: CASE WHEN len(list_filter(acc, lambda k: {_HOLDS.replace('x[1]', 'z[1][1]')})) > 0 THEN acc ELSE list_concat(acc, z) END) AS kept FROM f) SELECT unnest(list_transform(kept[n + 1:n + 60], lambda k: k[1])) AS phrase, unnest(range(1, len(kept[n + 1:n + 60]) + 1))::INT AS place FROM w")
def extra_phrases(s, d):
    """A second list: the next 60 that neither meet the first 20 nor one another."""
    items, conflicts = _walked(s, d)
    shown = items.orderBy("rank", "id").limit(20).select("id")
    return grouping.extra_list(items, shown, conflicts, 60).select(F.col("id").alias("phrase"), F.col("place").cast("int").alias("place"))


_CARDS = """o AS (SELECT o_orderkey AS doc_id, n_name, c_mktsegment, strftime(o_orderdate, '%Y-%m') AS m FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT 'n:' || n_name AS card, 'nation' AS layer, doc_id FROM o UNION ALL SELECT 's:' || c_mktsegment || ':' || n_name, 'segment', doc_id FROM o UNION ALL SELECT 'm:' || m, 'month', doc_id FROM o),
z AS (SELECT card, layer, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 8), c AS (SELECT card, layer, n, row_number() OVER (ORDER BY n * 37 % 101, card) AS r, count(*) OVER () AS t FROM z)"""


def _members(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cards = F.array(*[F.struct(a.alias("card"), F.lit(b).alias("layer")) for a, b in ((F.concat(F.lit("n:"), "n_name"), "nation"), (F.concat(F.lit("s:"), "c_mktsegment", F.lit(":"), "n_name"), "segment"), (F.concat(F.lit("m:"), F.date_format("o_orderdate", "yyyy-MM")), "month"))])
    return o.select(F.col("o_orderkey").alias("doc_id"), F.explode(cards).alias("c")).select("c.card", "c.layer", "doc_id")


@query(f"""WITH {_CARDS}, conf AS (SELECT a.card AS a, b.card AS b FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.card <> b.card JOIN z za ON za.card = a.card JOIN z zb ON zb.card = b.card GROUP BY a.card, b.card, za.n, zb.n HAVING count(*) / least(za.n, zb.n) >= 0.5),
cl AS (SELECT list(a || '|' || b) AS cf FROM conf), walk AS (SELECT list([card] ORDER BY r) AS l FROM c),
w AS (SELECT list_reduce(list_transform(l, lambda y: [y]), lambda acc, q: CASE WHEN len(list_filter(acc, lambda k: list_contains(cf, k[1] || '|' || q[1][1]))) > 0 THEN acc ELSE list_concat(acc, q) END) AS kept, cf FROM walk, cl),
led AS (SELECT card, layer, (t - r + 1) / t AS rank, list_filter(kept, lambda k: k[1] = card OR list_contains(cf, k[1] || '|' || card))[1][1] AS leader FROM c, w),
best AS (SELECT leader, layer, max(rank) AS best, count(*) AS k FROM led GROUP BY ALL), g AS (SELECT leader, sum(k)::BIGINT AS n_evidence, string_agg(layer, ',' ORDER BY layer) AS layers, sum(best) + 0.5 * (count(*) - 1) AS score FROM best GROUP BY ALL),
nd AS (SELECT leader, count(DISTINCT doc_id)::BIGINT AS n_docs FROM m JOIN led USING (card) GROUP BY ALL)
SELECT leader AS card, n_evidence, layers, round(score, 6)::DOUBLE AS score, n_docs FROM g JOIN nd USING (leader)""")
def merged_cards(s, d):
    """Cards of nations, segments within nations and months; what overlaps by half joins the better card."""
    from glimmer.operators.rank import numbered

    members = _members(s, d)
    sizes = members.groupBy("card", "layer").agg(F.count(F.lit(1)).alias("n")).where("n >= 8")
    placed = numbered(sizes, [F.col("n") * 37 % 101, F.col("card")], "r").join(F.broadcast(sizes.agg(F.count(F.lit(1)).alias("t"))))
    cards = grouping.merged_cards(placed.select("card", "layer", ((F.col("t") - F.col("r") + 1) / F.col("t")).alias("rank")), members.select("card", "doc_id"))
    return cards.withColumn("score", F.round("score", 6))


# Claims: titles that name a term in several ways, and terms with several names.
_NAMES = ("edge computing", "quantum key distributions", "the of", "vibe coding", "квантовый ключ", "")
_TITLES = ("A deep-edge computing chip", "Edge computing for all", "On edgecomputing hardware", "Edge-computing at last", "Cutting-edge caching", "The EDGE COMPUTINGS, again", "Quantum key distribution in analyses", "Key-distribution quantum", "Vibecoding tools", "О краевых вычислениях", "", "Vibe – coding", "Квантовый ключ сегодня")
_CANON = ("computing edge", "homomorphic encryption", "Edge Computing", None)
_ALIAS = ("computing at the edge", "edge-computing", "Keys distribution: quantum", "coding vibes")


def _case_sql(words, at):
    return "(" + str(["" if w is None else w for w in words]) + f")[1 + ({at}) % {len(words)}]"


_STEM3 = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:length(w) - 3] || 'y' WHEN length(w) > 4 AND w LIKE '%ses' THEN w[:length(w) - 2] WHEN length(w) > 3 AND w LIKE '%s' AND NOT w LIKE '%ss' THEN w[:length(w) - 1] ELSE w END"
_TOKS = lambda x: f"list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: {_STEM3})"
_STOPS = _in(claims.stop_stems())
_GOOD = lambda t: f"(len({t}) > 0 AND len(list_filter({t}, lambda w: w NOT IN {_STOPS})) > 0)"


@query(rf"""WITH x AS (SELECT o_orderkey AS id, {_case_sql(_TITLES, "o_orderkey")} AS title, {_case_sql(_NAMES, "o_orderkey // 13")} AS own, nullif({_case_sql(_CANON, "o_orderkey // 78")}, '') AS canon, {_case_sql(_ALIAS, "o_orderkey // 7")} AS alias, CASE WHEN o_orderkey % 3 = 0 THEN {_case_sql(_ALIAS, "o_orderkey // 7")} END AS att FROM orders),
t AS (SELECT *, {_TOKS('own')} AS o, {_TOKS('canon')} AS c, {_TOKS('alias')} AS a, {_TOKS('att')} AS f FROM x),
n1 AS (SELECT *, CASE WHEN {_GOOD('o')} THEN [o] ELSE [] END AS first FROM t),
n2 AS (SELECT *, CASE WHEN {_GOOD('c')} AND len(list_filter(first, lambda k: list_sort(k) = list_sort(c))) > 0 THEN list_concat(first, [c]) ELSE first END AS second FROM n1),
n3 AS (SELECT *, CASE WHEN {_GOOD('a')} AND len(list_filter(second, lambda k: list_sort(k) = list_sort(a))) > 0 THEN list_concat(second, [a]) ELSE second END AS names,
 trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '([\p{{L}}\p{{N}}_])[-\x{{2011}}]+([\p{{L}}\p{{N}}_])', '\1§\2', 'g'), '([\p{{L}}\p{{N}}_])[-\x{{2011}}]+([\p{{L}}\p{{N}}_])', '\1§\2', 'g'), '[^\p{{L}}\p{{N}}_§]+', ' ', 'g')) AS raw FROM n2),
l AS (SELECT *, ' ' || array_to_string(list_transform(string_split(raw, ' '), lambda p: array_to_string(list_transform(string_split(p, '§'), lambda w: {_STEM3}), '-')), ' ') || ' ' AS line, array_to_string(list_transform(names, lambda k: array_to_string(k, ' ')), ' ') AS named FROM n3)
SELECT id, CASE WHEN len(o) = 0 AND len(c) = 0 AND len(a) = 0 THEN 'IDENTITY_NOT_DEFINED' WHEN len(names) = 0 THEN 'NO_AUTHORITATIVE_NAME' WHEN len(list_filter(names, lambda k: regexp_matches(line, ' ' || array_to_string(k, '[ -]') || ' '))) > 0 THEN 'direct' WHEN len(list_filter(names, lambda k: len(k) >= 2 AND regexp_matches(line, '[ -]' || array_to_string(k, '') || '[ -]'))) > 0 THEN 'glued'
 WHEN att IS NOT NULL AND len(list_filter(names, lambda k: len(f) > 0 AND list_sort(k) = list_sort(f))) = 0 THEN 'ATTACHMENT_NOT_AUTHORITATIVE' WHEN trim(line) = '' THEN 'NO_TITLE' WHEN regexp_matches(named, '[a-z0-9]') <> regexp_matches(line, '[a-z0-9]') THEN 'CROSS_LANGUAGE_UNVERIFIED' ELSE 'NOT_NAMED' END AS claim FROM l""")
def claim_match(s, d):
    pick = lambda words, at: F.array(*[F.lit(w) for w in words])[(at % len(words)).cast("int")]
    i = F.col("id")
    over = lambda n: F.floor(i / n)
    alias = pick(_ALIAS, over(7))
    rows = ids(s, d).select("id", pick(_TITLES, i).alias("title"), pick(_NAMES, over(13)).alias("own"), pick(_CANON, over(78)).alias("canon"), F.array(alias).alias("merged"), F.when(i % 3 == 0, alias).alias("att"))
    return rows.select("id", claims.claim_state(F.col("title"), F.col("own"), F.col("canon"), F.col("merged"), F.col("att")).alias("claim"))


# Orders as documents of part names: nations are topics and countries, customers organisations, priorities domains.
_DOCS = "docs1 AS (SELECT o_orderkey AS doc_id, year(o_orderdate) AS year, n_name AS topic, o_custkey AS org, n_regionkey AS country, c_mktsegment AS venue, o_orderpriority AS domain, c_acctbal > 5000 AS industry, o_orderstatus = 'P' AS preprint, n_regionkey = 2 AS home, o_totalprice AS cited FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), found1 AS (SELECT lower(p_name) AS entity, l_orderkey AS doc_id, bool_or(l_linenumber = 1) AS in_title, count(*) AS votes FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


def _docs(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"), F.col("n_name").alias("topic"), F.col("o_custkey").alias("org"), F.col("n_regionkey").alias("country"), F.col("c_mktsegment").alias("venue"), F.col("o_orderpriority").alias("domain"), (F.col("c_acctbal") > 5000).alias("industry"), (F.col("o_orderstatus") == "P").alias("preprint"), (F.col("n_regionkey") == 2).alias("home"), F.col("o_totalprice").alias("cited"))


def _found(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.lower("p_name").alias("entity"), F.col("l_orderkey").alias("doc_id")).agg(F.max(F.col("l_linenumber") == 1).alias("in_title"), F.count(F.lit(1)).alias("votes"))


_SHARE = lambda c: f"round(sum(({c})::INT) / count(*), 6) AS"


@query(f"""WITH {_DOCS}, past AS (SELECT * FROM docs1 WHERE year BETWEEN 1995 AND 1999), py AS (SELECT year, count(*) AS ny FROM past GROUP BY ALL), el AS (SELECT org FROM past GROUP BY org ORDER BY count(*) DESC, org LIMIT 100),
r AS (SELECT entity, past.*, in_title, ny, org IN (SELECT org FROM el) AS elite FROM found1 JOIN past USING (doc_id) JOIN py USING (year)),
e AS (SELECT entity, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS e FROM (SELECT entity, topic, count(*) AS c FROM r GROUP BY ALL) GROUP BY ALL),
g AS (SELECT entity, count(*) AS n_docs, count(*) FILTER (year BETWEEN 1997 AND 1999) AS recent_docs, count(*) FILTER (year BETWEEN 1994 AND 1996) AS prior_docs, count(*) FILTER (in_title) AS title_docs, coalesce(sum(1000 / ny) FILTER (year BETWEEN 1997 AND 1999), 0) / 3 AS rr, coalesce(sum(1000 / ny) FILTER (year BETWEEN 1995 AND 1996), 0) / 2 AS pr,
 ln(1 + count(*) FILTER (year = 1999)) - 2 * ln(1 + count(*) FILTER (year = 1998)) + ln(1 + count(*) FILTER (year = 1997)) AS accel, count(*) FILTER (year = 1999) AS now, 1999 - min(year) AS age, count(DISTINCT year) AS active, count(DISTINCT topic) AS n_topics, count(DISTINCT org) / count(*) AS opd, count(DISTINCT country) AS n_countries, count(DISTINCT domain) AS domain_spread, count(DISTINCT venue) / count(*) AS vpd,
 avg(home::INT) AS h, avg(industry::INT) AS i, avg(elite::INT) AS el, avg(preprint::INT) AS p FROM r GROUP BY entity)
SELECT entity, n_docs, recent_docs, prior_docs, title_docs, round(rr, 6) AS recent_rate, round(pr, 6) AS prior_rate, round(ln((rr + 0.5) / (pr + 0.5)), 6) + 0.0 AS growth, round(accel, 6) + 0.0 AS accel, round(now / greatest(recent_docs, 1), 6) AS last_share, age::INT AS first_year_age, greatest(0, age + 1 - active)::INT AS dormancy, active::INT AS active_years, round(e / ln(greatest(2, least(n_docs, (SELECT count(DISTINCT topic) FROM past)))), 6) + 0.0 AS topic_entropy, n_topics::INT AS n_topics, round(opd, 6) AS org_per_doc, n_countries::INT AS n_countries, round(h, 6) AS home_share, round(i, 6) AS industry_share, round(el, 6) AS elite_share, round(p, 6) AS preprint_share, round(title_docs / n_docs, 6) AS title_share, domain_spread::INT AS domain_spread, round(vpd, 6) AS venue_per_doc FROM g JOIN e USING (entity)""")
def term_features(s, d):
    f = early.term_features(_found(s, d).drop("votes"), _docs(s, d).drop("cited"), 1999, 1995)
    return f.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])


@query(f"WITH {TRADE_SQL}, y AS (SELECT year, sum(n_docs) AS n FROM totals GROUP BY ALL), r AS (SELECT entity, docs, year, docs / greatest(n, 1) * 1000 AS r FROM dense JOIN y USING (year)), g AS (SELECT entity, sum(r) FILTER (year BETWEEN 1995 AND 1997) / 3 AS b, sum(r) FILTER (year BETWEEN 2000 AND 2001) / 2 AS o, sum(docs) FILTER (year BETWEEN 2000 AND 2001)::BIGINT AS outcome_docs FROM r GROUP BY ALL) SELECT entity, round(o / greatest(b, 1e-9), 4) AS ratio, outcome_docs, o / greatest(b, 1e-9) >= 1.3 AND outcome_docs >= 3 AS takeoff FROM g")
def takeoff_by_rate(s, d):
    from glimmer.operators import axes

    series = axes.share_series(_cube(s, d), trade_totals(s, d), 1995, 2001)
    yearly = trade_totals(s, d).groupBy("year").agg(F.sum("n_docs").alias("n"))
    return early.rate_label(series, yearly, 1997, 2001, 1.3, 3).withColumn("ratio", F.round("ratio", 4))


@query(f"WITH {TRADE_SQL}, g AS (SELECT entity, sum(docs) FILTER (year BETWEEN 1995 AND 1997) / 3 AS b, sum(docs) FILTER (year BETWEEN 2000 AND 2001) AS f FROM dense GROUP BY ALL) SELECT entity, round((f / 2 + 0.5) / (b + 0.5), 6) AS ratio, (f / 2 + 0.5) / (b + 0.5) >= 1.3 AND f >= 3 AS takeoff FROM g")
def takeoff_by_count(s, d):
    from glimmer.operators import axes

    return early.count_label(axes.share_series(_cube(s, d), trade_totals(s, d), 1995, 2001), 1997, 2001, 1.3, 3).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {_DOCS}, r AS (SELECT entity, docs1.*, votes, CASE WHEN year = 2001 THEN 12.0::DOUBLE / 7 ELSE 1 END AS w FROM found1 JOIN docs1 USING (doc_id)),
g AS (SELECT entity, count(*) AS n_docs, coalesce(sum(w) FILTER (year BETWEEN 1999 AND 2001), 0) / 3 AS r, coalesce(sum(w) FILTER (year BETWEEN 1995 AND 1997), 0) / 3 AS p, count(*) FILTER (year >= 1999 AND country = 2) / greatest(1, count(*) FILTER (year >= 1999)) AS hr, count(*) FILTER (year < 1999 AND country = 2) / greatest(1, count(*) FILTER (year < 1999)) AS hp, coalesce(sum(w) FILTER (year = 2001), 0) AS now, count(*) FILTER (year = 1999) AS before, count(DISTINCT org) FILTER (industry) AS n_industry FROM r GROUP BY ALL),
b AS (SELECT entity, min(year) FILTER (n >= 3) AS birth FROM (SELECT entity, year, sum(w) AS n FROM r GROUP BY ALL) GROUP BY ALL),
o AS (SELECT entity, org, bool_or(industry) AS ind, count(*) AS k FROM r GROUP BY ALL),
t AS (SELECT entity, string_agg(org::VARCHAR, ',' ORDER BY k DESC, org) AS top_orgs FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY entity ORDER BY k DESC, org) <= 5) GROUP BY ALL),
f AS (SELECT entity, string_agg(org::VARCHAR, ',' ORDER BY org) AS industry FROM (SELECT * FROM o WHERE ind QUALIFY row_number() OVER (PARTITION BY entity ORDER BY org) <= 8) GROUP BY ALL),
x AS (SELECT entity, string_agg(doc_id::VARCHAR, ',' ORDER BY votes DESC, cited DESC, year DESC, doc_id) AS examples FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity ORDER BY votes DESC, cited DESC, year DESC, doc_id) <= 3) GROUP BY ALL)
SELECT entity, n_docs, birth::INT AS birth_year, round(ln((r + 1) / (p + 1)), 6) + 0.0 AS growth, round(hr, 6) AS home_recent, round(hp, 6) AS home_prior, n_industry::BIGINT AS n_industry, coalesce(industry, '') AS industry, top_orgs, examples,
 concat_ws('; ', CASE WHEN hr - hp >= 0.15 THEN 'home share rose' END, CASE WHEN n_industry > 0 THEN 'industry has it' ELSE 'academic so far' END, CASE WHEN now > 2 * greatest(1, before) THEN 'yearly rate more than doubled' END) AS signals FROM g JOIN b USING (entity) JOIN t USING (entity) LEFT JOIN f USING (entity) JOIN x USING (entity)""")
def early_cards(s, d):
    """Cards of part names over orders."""
    cards = early.signal_cards(_found(s, d).drop("in_title"), _docs(s, d), 2001, 2, 12.0 / 7)
    return cards.withColumns({"growth": F.round("growth", 6) + F.lit(0.0), "home_recent": F.round("home_recent", 6), "home_prior": F.round("home_prior", 6)})


_W = {"hn": "BUILDING", "yc": "MACHINERY", "press": "FURNITURE"}


@query(f"""WITH {TRADE_SQL}, c AS (SELECT entity, source, year, count(*) AS df FROM names GROUP BY ALL), n AS (SELECT sum(n_docs) FILTER (year BETWEEN 1999 AND 2001) AS nr, sum(n_docs) FILTER (year BETWEEN 1995 AND 1997) AS nb FROM totals WHERE source = 'BUILDING'),
g AS (SELECT entity, coalesce(sum(df) FILTER (source = 'BUILDING' AND year BETWEEN 1999 AND 2001), 0)::BIGINT AS hr, coalesce(sum(df) FILTER (source = 'BUILDING' AND year BETWEEN 1995 AND 1997), 0)::BIGINT AS hb, coalesce(sum(df) FILTER (source = 'MACHINERY' AND year BETWEEN 1999 AND 2001), 0)::BIGINT AS yr, coalesce(sum(df) FILTER (source = 'FURNITURE' AND year BETWEEN 1999 AND 2001), 0)::BIGINT AS pr, coalesce(sum(df) FILTER (source IN ('HOUSEHOLD', 'AUTOMOBILE') AND year BETWEEN 1999 AND 2001), 0)::BIGINT AS sr FROM c GROUP BY ALL),
f AS (SELECT entity, min(year) FILTER (d >= 2) AS fy FROM (SELECT entity, year, sum(df) AS d FROM c WHERE source IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY ALL) GROUP BY ALL),
k AS (SELECT g.*, coalesce(fy, 0) AS fy, hr % 7 AS la, CASE WHEN hr + hb >= 3 THEN log2(((hr + 1) / nr) / ((hb + 1) / nb)) END AS growth, hr / nr AS rate FROM g LEFT JOIN f USING (entity), n),
q AS (SELECT *, hr + yr + pr AS v, (sr > 0)::INT + (hr > 0)::INT + (yr > 0)::INT + (pr > 0)::INT AS layers FROM k)
SELECT entity, v::BIGINT AS volume, layers::INT AS layers, v >= 5 AND (coalesce(growth >= 0.1, false) OR fy >= 1997 OR yr >= 2) AND rate <= 0.5 AS candidate, round(least(greatest(coalesce(growth, 0), 0), 6) + (fy >= 1997)::INT + 0.7 * ln(1 + yr) + 0.3 * ln(1 + la) + 0.5 * least(greatest(layers - 1, 0), 3) - 0.5 * log10(greatest(v / 200, 1)), 6) AS score FROM q""")
def business_score(s, d):
    """Part names by the segments of their orders: one a community, one startups, one press, two science."""
    c = cube.count_cube(trade_names(s, d), once=True)
    p, totals = TRADE, trade_totals(s, d).where(F.col("source") == _W["hn"])
    n = totals.agg(score.during("n_docs", p.recent).alias("nr"), score.during("n_docs", p.base).alias("nb"))
    of = lambda names, years: score.during(F.when(F.col("source").isin(*names), F.col("df")), years).cast("long")
    rows = c.groupBy("entity").agg(of([_W["hn"]], p.recent).alias("hn_recent"), of([_W["hn"]], p.base).alias("hn_base"), of([_W["yc"]], p.recent).alias("yc_recent"), of([_W["press"]], p.recent).alias("press_recent"), of(["HOUSEHOLD", "AUTOMOBILE"], p.recent).alias("sci_recent"))
    rows = rows.join(score.first_year(c.where(F.col("source").isin(*_W.values())), 2, p.cutoff), "entity", "left").fillna({"first_year": 0}).join(F.broadcast(n))
    growth = F.when(F.col("hn_recent") + F.col("hn_base") >= 3, F.log2(((F.col("hn_recent") + 1) / F.col("nr")) / ((F.col("hn_base") + 1) / F.col("nb"))))
    rows = rows.withColumns({"growth": growth, "hn_rate": F.col("hn_recent") / F.col("nr"), "launches": F.col("hn_recent") % 7, "generic": F.lit(False), "super_share": F.lit(0.0)})
    return score.business_scored(rows, 5, 0.1, 1997, 0.5).select("entity", "volume", "layers", "candidate", F.round("score", 6).alias("score"))


_LEX = r"\b(steel|mes|plc)\b|\b(widget|bolt|gear|industrial)"


@query(rf"""WITH x AS (SELECT p_partkey AS id, lower(p_name) || ' ' || (p_partkey % 97)::VARCHAR AS phrase, p_partkey % 5 = 0 AS fragment, p_partkey % 7 = 0 AS umbrella, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 6 END AS projects, CASE WHEN p_partkey % 4 > 0 THEN (p_size % 10) / 10.0 END AS share, CASE WHEN p_partkey % 6 > 0 THEN 2016 + p_size % 9 END AS fy, (p_partkey * 7 % 10) / 10.0 AS theory, CASE WHEN p_partkey % 8 > 0 THEN (p_partkey * 13 % 101) / 101.0::DOUBLE END AS e, (p_partkey * 29 % 89) / 89.0::DOUBLE AS h FROM part),
f AS (SELECT *, regexp_matches(phrase, '{_LEX}') AS w FROM x WHERE NOT fragment AND NOT umbrella AND phrase NOT IN (SELECT phrase FROM x WHERE id % 10 = 1)),
k AS (SELECT * FROM f WHERE (w OR (coalesce(projects, 0) >= 3 AND coalesce(share >= 0.3, false))) AND NOT coalesce(fy <= 2019, false) AND NOT theory >= 0.6),
b AS (SELECT phrase, id, w, 0.7 * CASE WHEN e IS NOT NULL THEN (rank() OVER (PARTITION BY e IS NULL ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2) / count(*) OVER (PARTITION BY e IS NULL) END + 0.3 * (rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2) / count(*) OVER () AS blend FROM k)
SELECT id, w AS by_word, round(blend, 6)::DOUBLE AS blend FROM b WHERE blend IS NOT NULL ORDER BY round(blend, 9) DESC, phrase LIMIT 1500""")
def industrial_candidates(s, d):
    k = F.col("p_partkey")
    rows = table(s, d, "part").select(k.alias("id"), F.concat_ws(" ", F.lower("p_name"), (k % 97).cast("string")).alias("phrase"), (k % 5 == 0).alias("fragment"), (k % 7 == 0).alias("umbrella"), F.when(k % 3 > 0, k % 6).alias("projects"), F.when(k % 4 > 0, F.col("p_size") % 10 / 10.0).alias("industry_share"), F.when(k % 6 > 0, 2016 + F.col("p_size") % 9).alias("first_year"), (k * 7 % 10 / 10.0).alias("theory_share"), F.when(k % 8 > 0, k * 13 % 101 / 101.0).alias("expert_p"), (k * 29 % 89 / 89.0).alias("history_p"))
    return base.industrial_candidates(rows, _LEX, rows.where("id % 10 = 1")).select("id", "by_word", F.round("blend", 6).alias("blend"))


_QST = "CASE " + " ".join(f"WHEN length(w) > 4 AND w LIKE '%{x}' THEN w[:length(w) - {len(x)}]" for x in base.QUOTE_SUFFIXES) + " ELSE w END"
_QW = lambda x: f"list_distinct(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: {_QST}))"


@query(f"""WITH x AS (SELECT p_partkey AS id, lower(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' systems' ELSE '' END AS phrase, CASE WHEN p_partkey % 4 = 0 THEN 'Launched rings and ' || lower(p_type) ELSE 'a new ' || lower(split_part(p_name, ' ', 2)) || 's pilot' END AS quote, (p_partkey * 7 % 50) / 100.0 AS sim, CASE p_partkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'combo' ELSE 'market' END AS kind, (p_partkey * 11 % 40) / 10.0 AS growth, (p_partkey * 13 % 97) / 97.0::DOUBLE AS expert FROM part),
w AS (SELECT *, list_filter({_QW('phrase')}, lambda w: w NOT IN {_in(base.QUOTE_FILL)}) AS ws, {_QW('quote')} AS qs FROM x),
c AS (SELECT *, CASE WHEN id % 9 > 0 THEN sim >= 0.4 OR len(ws) = 0 OR len(list_intersect(ws, qs)) >= greatest(1, (len(ws) + 1) // 2) END AS confirmed FROM w),
n AS (SELECT id, 0.55 + 0.4 * (rank() OVER (ORDER BY growth) + (count(*) OVER (PARTITION BY growth) - 1) / 2) / count(*) OVER () AS score FROM c WHERE kind <> 'base' AND confirmed)
SELECT id, round(score, 6)::DOUBLE AS score FROM n UNION ALL SELECT id, round(expert * CASE WHEN confirmed = false THEN 0.7 ELSE 1 END, 6)::DOUBLE FROM c WHERE kind = 'base'""")
def passport_scores(s, d):
    """Quotes that are about their phrase confirm it; a ninth of the phrases was never asked about."""
    k = F.col("p_partkey")
    phrase = F.concat(F.lower("p_name"), F.when(k % 3 == 0, " systems").otherwise(""))
    quote = F.when(k % 4 == 0, F.concat(F.lit("Launched rings and "), F.lower("p_type"))).otherwise(F.concat(F.lit("a new "), F.lower(F.split("p_name", " ")[1]), F.lit("s pilot")))
    kind = F.when(k % 3 == 0, "base").when(k % 3 == 1, "combo").otherwise("market")
    confirmed = F.when(k % 9 > 0, base.quote_is_about(phrase, quote, k * 7 % 50 / 100.0))
    rows = table(s, d, "part").select(k.alias("id"), kind.alias("kind"), confirmed.alias("confirmed"), (k * 11 % 40 / 10.0).alias("growth"), (k * 13 % 97 / 97.0).alias("expert"))
    return base.passport_scores(rows).select("id", F.round("score", 6).alias("score"))
