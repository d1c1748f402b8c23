"""Queries over the trade panel: cubes, scores, axes, labels, pairs, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import axes, cube, history, pairs, rank, score
from glimmer.plans.panels import PAST, TRADE, TRADE_SQL, query, table, trade_docs, trade_found, trade_names, trade_totals


def _cube(s, d):
    return cube.count_cube(trade_found(s, d), once=True)


def _series(s, d):
    return axes.share_series(_cube(s, d), trade_totals(s, d), 1995, 2001)


def _groups(s, d):
    sizes = trade_docs(s, d).where(F.col("year").between(1999, 2001)).groupBy("grp").agg(F.count(F.lit(1)).alias("n_docs"))
    return cube.count_cube(trade_found(s, d).where(F.col("year").between(1999, 2001)), ("entity", "grp"), once=True), sizes


@query(f"WITH {TRADE_SQL} SELECT entity, source, year::INT AS year, df::BIGINT AS df FROM cube")
def trade_cube(s, d):
    return _cube(s, d)


@query(f"WITH {TRADE_SQL} SELECT source, year::INT AS year, grp, count(*)::BIGINT AS n_docs FROM docs GROUP BY GROUPING SETS ((source, year), (source, year, grp))")
def trade_totals_gs(s, d):
    return cube.denominators(trade_docs(s, d))


@query(f"WITH {TRADE_SQL} SELECT entity, coalesce(k.grp, 'other') AS grp, count(DISTINCT doc_id)::BIGINT AS df FROM found LEFT JOIN (SELECT n_name AS grp FROM nation WHERE n_regionkey < 2) k USING (grp) WHERE year BETWEEN 1999 AND 2001 GROUP BY ALL")
def group_counts_other(s, d):
    known = table(s, d, "nation").where("n_regionkey < 2").select(F.col("n_name").alias("grp"))
    return cube.group_counts(trade_found(s, d), known, TRADE.recent)


@query(f"WITH {TRADE_SQL} SELECT * FROM sums")
def window_sums(s, d):
    return score.window_sums(_cube(s, d), trade_totals(s, d), TRADE)


_GROWTH = "growth AS (SELECT entity, avg(CASE WHEN d_recent + d_base >= 3 AND n_recent > 0 AND n_base > 0 THEN log2(((d_recent + 1) / n_recent) / ((d_base + 1) / n_base)) END) AS growth FROM sums GROUP BY ALL)"


@query(f"WITH {TRADE_SQL}, {_GROWTH} SELECT entity, round(growth, 6) AS growth FROM growth")
def growth_log2(s, d):
    return score.growth(window_sums(s, d)).withColumn("growth", F.round("growth", 6))


@query(f"WITH {TRADE_SQL} SELECT entity, sum(d_recent)::BIGINT AS volume, round(max(CASE WHEN n_recent > 0 THEN d_recent / n_recent ELSE 0 END), 9) AS max_rate, count(*) FILTER (d_recent > 0)::BIGINT AS n_sources FROM sums GROUP BY ALL")
def volumes_rates(s, d):
    return score.volumes(window_sums(s, d)).withColumn("max_rate", F.round("max_rate", 9))


@query(f"WITH {TRADE_SQL} SELECT entity, coalesce(min(year) FILTER (n >= 2), 0)::INT AS first_year FROM (SELECT entity, year, sum(df) AS n FROM cube WHERE year <= 2001 GROUP BY ALL) GROUP BY ALL")
def first_year_k(s, d):
    return score.first_year(_cube(s, d), 2, 2001)


_SPREAD = """big AS (SELECT * FROM sizes WHERE n_docs >= 10), rates AS (SELECT entity, g.df, g.df / big.n_docs AS rate FROM groups g JOIN big USING (grp)),
tot AS (SELECT *, sum(rate) OVER (PARTITION BY entity) AS r FROM rates),
spread AS (SELECT entity, CASE WHEN sum(df) >= 3 THEN -sum(rate / r * ln(rate / r)) / nullif(ln((SELECT count(*) FROM big)), 0) END AS spread FROM tot GROUP BY ALL)"""


@query(f"WITH {TRADE_SQL}, {_SPREAD} SELECT entity, round(spread, 6) + 0.0 AS spread FROM spread")
def group_entropy_spread(s, d):
    return score.spread(*_groups(s, d), 10, 3).withColumn("spread", F.round("spread", 6) + F.lit(0.0))


_ALL = f"""{TRADE_SQL}, {_GROWTH}, {_SPREAD},
fy AS (SELECT entity, coalesce(min(year) FILTER (n >= 2), 0) AS first_year FROM (SELECT entity, year, sum(df) AS n FROM cube GROUP BY ALL) GROUP BY ALL),
vol AS (SELECT entity, sum(d_recent) AS volume, max(CASE WHEN n_recent > 0 THEN d_recent / n_recent ELSE 0 END) AS max_rate, count(*) FILTER (d_recent > 0) AS n_sources FROM sums GROUP BY ALL),
scored AS (SELECT *, volume >= 3 AND (coalesce(growth >= 1, false) OR first_year >= 1997) AND max_rate <= 1 AND (spread IS NULL OR spread <= 0.999) AND n_sources >= 1 AS candidate,
  least(greatest(coalesce(growth, 0), 0), 6) + (first_year >= 1997)::INT + 0.5 * least(greatest(n_sources - 1, 0), 2) - coalesce(spread, 0.5) - 0.5 * log10(greatest(volume / 20, 1)) AS score
  FROM vol JOIN growth USING (entity) JOIN fy USING (entity) LEFT JOIN spread USING (entity))"""


def _scored(s, d):
    return score.scored(_cube(s, d), trade_totals(s, d), *_groups(s, d), TRADE)


@query(f"WITH {_ALL} SELECT entity, volume::BIGINT AS volume, candidate FROM scored WHERE candidate")
def candidates(s, d):
    return _scored(s, d).where("candidate").select("entity", "volume", "candidate")


@query(f"WITH {_ALL} SELECT entity, volume::BIGINT AS volume, round(score, 6) AS score FROM scored WHERE candidate ORDER BY round(score, 6) DESC, entity LIMIT 15")
def hand_score_top15(s, d):
    return _scored(s, d).where("candidate").select("entity", "volume", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "entity").limit(15)


@query(f"WITH {TRADE_SQL} SELECT entity, year, docs, round(share, 9) AS share FROM dense")
def share_series_dense(s, d):
    return _series(s, d).withColumn("share", F.round("share", 9))


@query(f"""WITH {TRADE_SQL}, l AS (SELECT *, share + 1e-7 AS s, lag(share + 1e-7, 1) OVER w AS s1, lag(share + 1e-7, 2) OVER w AS s2, max(share) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak,
  sum(docs) OVER w AS a, sum(docs) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM dense WINDOW w AS (PARTITION BY entity ORDER BY year))
SELECT entity, round(log2(s / s1) - log2(s1 / s2), 6) + 0.0 AS accel, round(CASE WHEN peak > 0 THEN share / peak END, 6) AS peak_ratio, round(CASE WHEN a > 0 THEN n / a END, 6) AS recent_share FROM l WHERE year = 2001""")
def stage_axis(s, d):
    return axes.stage(_series(s, d), TRADE).select("entity", (F.round("accel", 6) + F.lit(0.0)).alias("accel"), F.round("peak_ratio", 6).alias("peak_ratio"), F.round("recent_share", 6).alias("recent_share"))


@query(f"""WITH {TRADE_SQL} SELECT entity, round((coalesce(sum(share) FILTER (year BETWEEN 1999 AND 2001), 0) + 1e-12) / (coalesce(sum(share) FILTER (year BETWEEN 1995 AND 1997), 0) + 1e-12), 4) AS acceleration FROM dense GROUP BY ALL
HAVING sum(docs) FILTER (year BETWEEN 1995 AND 1997) > 0""")
def share_acceleration(s, d):
    series = _series(s, d)
    seen = series.where(F.col("year").between(1995, 1997) & (F.col("docs") > 0)).select("entity").distinct()
    return axes.acceleration(series, (1999, 2001), (1995, 1997)).join(seen, "entity", "left_semi").withColumn("acceleration", F.round("acceleration", 4))


def _phrases(s, d):
    """P3: type and name of a part as a phrase of three words, and the name alone."""
    rows = trade_found(s, d).where(F.col("year").between(1999, 2001)).join(table(s, d, "part").select(F.col("p_partkey").alias("entity"), F.lower("p_name").alias("name"), F.lower("p_type").alias("type")), "entity")
    both = rows.select("doc_id", F.explode(F.array(F.concat_ws(" ", "type", "name"), F.col("name"))).alias("phrase")).distinct()
    return both.groupBy("phrase").agg(F.count(F.lit(1)).alias("volume"))


_P3 = f"""{TRADE_SQL}, ph AS (SELECT DISTINCT doc_id, unnest([lower(p_type) || ' ' || lower(p_name), lower(p_name)]) AS phrase FROM found JOIN part ON p_partkey = entity WHERE year BETWEEN 1999 AND 2001),
phrases AS (SELECT phrase, count(*) AS volume FROM ph GROUP BY ALL)"""


@query(f"""WITH {_P3}, w AS (SELECT phrase, volume, string_split(phrase, ' ') AS w FROM phrases), n AS (SELECT *, unnest(range(1, len(w))) AS n FROM w), i AS (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM n),
sup AS (SELECT array_to_string(w[i:i + n - 1], ' ') AS phrase, max(volume) AS best FROM i GROUP BY 1)
SELECT phrase, volume::BIGINT AS volume, round(coalesce(best, 0) / volume, 6) AS super_share FROM phrases LEFT JOIN sup USING (phrase)""")
def superphrase_share(s, d):
    return score.super_share(_phrases(s, d)).withColumn("super_share", F.round("super_share", 6))


@query(f"""WITH {_P3}, w AS (SELECT phrase, volume, string_split(phrase, ' ') AS w FROM phrases),
c AS (SELECT phrase, 1 AS pos, w[len(w)] AS parent FROM w WHERE len(w) > 1 UNION ALL SELECT phrase, 2, array_to_string(w[len(w) - 1:], ' ') FROM w WHERE len(w) > 2 UNION ALL SELECT phrase, 3, array_to_string(w[2:], ' ') FROM w WHERE len(w) > 1 UNION ALL SELECT phrase, 4, array_to_string(w[:len(w) - 1], ' ') FROM w WHERE len(w) > 1),
m AS (SELECT c.phrase, c.parent, p.volume AS pv FROM c JOIN phrases p ON p.phrase = c.parent AND p.volume >= 10 QUALIFY row_number() OVER (PARTITION BY c.phrase ORDER BY p.volume DESC, pos) = 1)
SELECT phrase, parent, round(ln(1 + pv), 6) AS parent_docs_log, round(log2((pv + 1) / (volume + 1)), 6) AS incremental_lex FROM phrases LEFT JOIN m USING (phrase)""")
def parent_axis(s, d):
    terms = _phrases(s, d).select("phrase", F.lit(1995).alias("first_year"), F.col("volume").alias("docs_now"))
    return axes.parent(terms, TRADE).select("phrase", "parent", F.round("parent_docs_log", 6).alias("parent_docs_log"), F.round("incremental_lex", 6).alias("incremental_lex"))


def _firsts(s, d):
    e = table(s, d, "events").where("ts < timestamp '2024-01-02'")
    return e.groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("layer")).agg(F.datediff(F.min(F.to_date("ts")), F.lit("2023-12-01").cast("date")).alias("first"))


_P4 = "f AS (SELECT user_id AS entity, event_type AS layer, date_diff('day', DATE '2023-12-01', min(ts)::DATE) AS first FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY ALL)"


@query(f"""WITH {_P4}, x AS (SELECT entity, min(first) FILTER (layer = 'view') AS s, min(first) FILTER (layer = 'click') AS c, min(first) FILTER (layer IN ('signup', 'purchase')) AS m, count(*) FILTER (layer <> 'view') AS r FROM f GROUP BY ALL)
SELECT entity, (r + 1)::BIGINT AS layer_count, r = 0 AS only_science, (c - s)::BIGINT AS lag_community, (m - s)::BIGINT AS lag_market FROM x""")
def layer_lags(s, d):
    return axes.layers(_firsts(s, d), "view", "click", ("signup", "purchase"))


@query(f"WITH {_P4} SELECT entity, count(*) FILTER (first <= 31)::BIGINT AS step FROM f GROUP BY ALL")
def ladder_step(s, d):
    return history.ladder(_firsts(s, d), F.lit(31))


def _yearly(s, d):
    return trade_totals(s, d).groupBy("year").agg(F.sum("n_docs").alias("n"))


_EVENT = """w AS (SELECT entity, year, sum(docs) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS d FROM dense),
n3 AS (SELECT year, greatest(sum(n) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 1) AS n3 FROM yearly), sh AS (SELECT entity, year, d, d / n3 AS s FROM w JOIN n3 USING (year)),
a AS (SELECT entity, s AS s0 FROM sh WHERE year = 1997),
ev AS (SELECT a.entity, coalesce(min(year - 1997) FILTER (year BETWEEN 1998 AND 2001 AND (s + 1e-9) / (s0 + 1e-9) >= 1.5 AND d >= 3), 0)::INT AS t_event FROM a JOIN sh USING (entity) GROUP BY ALL)"""


@query(f"WITH {TRADE_SQL}, {_EVENT} SELECT * FROM ev")
def event_time_takeoff(s, d):
    return history.event_time(_series(s, d), _yearly(s, d), PAST, 2001)


@query(f"WITH {TRADE_SQL}, {_EVENT}, x AS (SELECT *, unnest(range(1, CASE WHEN t_event > 0 THEN least(t_event, 4) ELSE 4 END + 1))::INT AS t FROM ev) SELECT entity, t, (t = t_event)::INT AS event FROM x")
def person_period(s, d):
    return history.person_period(event_time_takeoff(s, d), 4)


_HAZ = f"""{TRADE_SQL}, {_EVENT}, x AS (SELECT *, unnest(range(1, CASE WHEN t_event > 0 THEN least(t_event, 4) ELSE 4 END + 1))::INT AS t FROM ev),
h AS (SELECT entity % 5 AS dom, t, avg((t = t_event)::INT) * 0.9 + 0.01 AS h FROM x GROUP BY ALL), c AS (SELECT entity, t, 1 - exp(sum(ln(1 - h)) OVER (PARTITION BY entity ORDER BY t)) AS p FROM ev JOIN h ON dom = entity % 5)"""


def _hazards(s, d):
    pp = person_period(s, d)
    h = pp.groupBy((F.col("entity") % 5).alias("dom"), "t").agg((F.avg("event") * 0.9 + 0.01).alias("h"))
    return event_time_takeoff(s, d).withColumn("dom", F.col("entity") % 5).join(h, "dom").select("entity", "t", "h")


@query(f"WITH {_HAZ} SELECT entity, t, round(p, 6) AS p FROM c")
def cum_hazard(s, d):
    return history.cumulative_hazard(_hazards(s, d)).withColumn("p", F.round("p", 6))


@query(f"WITH {_HAZ} SELECT entity, min(t) FILTER (p >= 0.3)::INT AS half FROM c GROUP BY ALL")
def takeoff_half_life(s, d):
    return history.takeoff_year(history.cumulative_hazard(_hazards(s, d)), 0.3)


@query(f"""WITH {TRADE_SQL}, v AS (SELECT entity, entity % 3 AS dom, round(sum(docs * 1.0) + any_value(entity % 97) / 100.0, 6)::DOUBLE AS p FROM dense GROUP BY entity),
q AS (SELECT dom, quantile_cont(p, [0.98, 0.95, 0.9, 0.8, 0.6, 0.3]) AS e, count(*) AS n FROM v GROUP BY ALL), g AS (SELECT quantile_cont(p, [0.98, 0.95, 0.9, 0.8, 0.6, 0.3]) AS e FROM v)
SELECT entity, dom::BIGINT AS dom, p, ['AAA', 'AA', 'A', 'BBB', 'BB', 'B', 'CCC'][1 + len(list_filter(CASE WHEN q.n >= 300 THEN q.e ELSE g.e END, lambda x: x >= p))] AS grade FROM v JOIN q USING (dom), g""")
def grade_by_domain(s, d):
    v = _series(s, d).groupBy("entity").agg(F.round(F.sum("docs") * 1.0 + F.first(F.col("entity") % 97) / 100.0, 6).alias("p")).select("entity", (F.col("entity") % 3).alias("dom"), "p")
    return history.grades(v, "dom")


@query(f"""WITH {TRADE_SQL}, a AS (SELECT entity, coalesce(sum(df) FILTER (year BETWEEN 1995 AND 1997), 0)::BIGINT AS d_now, coalesce(sum(df) FILTER (year BETWEEN 1999 AND 2001), 0)::BIGINT AS d_future FROM cube GROUP BY ALL),
t AS (SELECT sum(n_docs) FILTER (year BETWEEN 1995 AND 1997) AS n, sum(n_docs) FILTER (year BETWEEN 1999 AND 2001) AS f FROM totals)
SELECT entity, d_now, d_future, (d_future / f + 1e-9) / (d_now / n + 1e-9) >= 1.5 AND d_future >= 3 AS takeoff FROM a, t""")
def takeoff_label(s, d):
    return history.takeoff_label(_cube(s, d), trade_totals(s, d), PAST, (1999, 2001))


@query(f"""WITH {TRADE_SQL}, c AS (SELECT entity, source AS science, coalesce(sum(df) FILTER (year <= 1998), 0) AS h, coalesce(sum(df) FILTER (year BETWEEN 1999 AND 2001), 0) AS r FROM cube GROUP BY ALL),
x AS (SELECT *, sum(h) OVER e AS ht, sum(r) OVER e AS rt, first_value(science) OVER (PARTITION BY entity ORDER BY h DESC, science) AS home FROM c WINDOW e AS (PARTITION BY entity)),
y AS (SELECT *, h <= 1 AND r >= 5 AND r >= 0.2 * greatest(rt, 1) AND science <> home AND ht >= 5 AS nw FROM x)
SELECT entity, bool_or(nw) AS migrant, home, coalesce(arg_min(science, row(-r, science)) FILTER (nw), '') AS target, coalesce(max(r) FILTER (nw), 0)::BIGINT AS target_recent, max(rt)::BIGINT AS recent_total, max(ht)::BIGINT AS hist_total FROM y GROUP BY entity, home""")
def migrants(s, d):
    return history.migrants(_cube(s, d).select("entity", F.col("source").alias("science"), "year", F.col("df").alias("n")), 2001)


@query(f"WITH {TRADE_SQL} SELECT entity, round(CASE WHEN sum(df) >= 5 THEN coalesce(sum(df) FILTER (grp IN (SELECT n_name FROM nation WHERE n_regionkey = 2)), 0) / sum(df) END, 6) AS share FROM groups GROUP BY ALL")
def topic_mask(s, d):
    chosen = table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("grp"), F.lit(True).alias("c"))
    return history.group_share(_groups(s, d)[0].join(chosen, "grp", "left"), F.coalesce("c", F.lit(False))).withColumn("share", F.round("share", 6))


@query(f"WITH {TRADE_SQL}, m AS (SELECT entity, min(year) FILTER (year > 1998 AND df / greatest(n_docs, 1) >= 0.02)::INT AS mass_year FROM cube JOIN totals USING (source, year) GROUP BY ALL) SELECT entity, mass_year, (mass_year - 1998)::INT AS lead_years FROM m")
def lead_years(s, d):
    return history.mass_year(_cube(s, d), trade_totals(s, d), 1998, 0.02)


_PIT = """pit AS (SELECT entity, coalesce(sum(docs) FILTER (year BETWEEN 1998 AND 2000), 0) / 3 AS recent_mean, coalesce(sum(docs) FILTER (year BETWEEN 1993 AND 1995), 0) / 3 AS prior_mean, (2000 - min(year) FILTER (docs >= 1))::INT AS age,
max(docs) FILTER (year < 2000) AS peak, coalesce(sum(docs) FILTER (year = 2000), 0) AS l, coalesce(sum(docs) FILTER (year = 1999), 0) AS l1, coalesce(sum(docs) FILTER (year = 1998), 0) AS l2, sum(docs) AS t, (1999 - max(year) FILTER (docs > 0 AND year < 2000))::INT AS dormancy FROM dense WHERE year <= 2000 GROUP BY ALL)"""


@query(f"WITH {TRADE_SQL}, {_PIT} SELECT entity, round(recent_mean, 6) AS recent_mean, round(prior_mean, 6) AS prior_mean, age, round(CASE WHEN peak > 0 THEN l / peak END, 6) AS peak_ratio, round(l / nullif(t, 0), 6) AS last_share, dormancy, round(ln(1 + l) - 2 * ln(1 + l1) + ln(1 + l2), 6) + 0.0 AS accel FROM pit")
def pit_features(s, d):
    r = lambda c: F.round(c, 6).alias(c)
    return history.features_at(_series(s, d), 2000).select("entity", r("recent_mean"), r("prior_mean"), "age", r("peak_ratio"), r("last_share"), "dormancy", (F.round("accel", 6) + F.lit(0.0)).alias("accel"))


@query(f"WITH {TRADE_SQL} SELECT entity, year, round(coalesce((docs - avg(docs) OVER y) / nullif(stddev_samp(docs) OVER y, 0), 0), 6) + 0.0 AS z FROM dense WINDOW y AS (PARTITION BY year)")
def zscore_by_freeze(s, d):
    return history.z_score(_series(s, d), "docs", ("year",)).select("entity", "year", (F.round("z", 6) + F.lit(0.0)).alias("z"))


@query(f"""WITH {TRADE_SQL}, b AS (SELECT entity, coalesce(sum(docs) FILTER (year BETWEEN 1999 AND 2001), 0)::BIGINT AS recent, coalesce(sum(docs) FILTER (year BETWEEN 1995 AND 1997), 0)::BIGINT AS prior FROM dense GROUP BY ALL),
e AS (SELECT entity, CASE WHEN count(*) > 1 THEN -sum(df / t * ln(df / t)) / ln(count(*)) ELSE 0 END AS entropy FROM (SELECT *, sum(df) OVER (PARTITION BY entity) AS t FROM groups) GROUP BY ALL)
SELECT entity, recent, prior, round(entropy, 6) + 0.0 AS entropy, round(log2((recent + 1) / (prior + 1)) * ln(recent) * (1 - entropy), 5) + 0.0 AS score FROM b JOIN e USING (entity) WHERE prior <= 5 AND recent >= 4""")
def burst_terms(s, d):
    return history.bursts(_series(s, d), _groups(s, d)[0], (1999, 2001), (1995, 1997), 5, 4, 1.1).select("entity", "recent", "prior", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"), (F.round("score", 5) + F.lit(0.0)).alias("score"))


@query(f"WITH {TRADE_SQL} SELECT entity, year, docs, round(1000.0 * docs / n, 6) AS per_thousand FROM dense JOIN yearly USING (year)")
def rate_per_thousand(s, d):
    return _series(s, d).join(_yearly(s, d), "year").select("entity", "year", "docs", F.round(1000.0 * F.col("docs") / F.col("n"), 6).alias("per_thousand"))


@query(f"WITH {TRADE_SQL} SELECT year::INT AS year, round(CASE WHEN year = 2001 THEN n * 12.0 / 7 ELSE n END, 6)::DOUBLE AS annual FROM yearly")
def annualised_last_year(s, d):
    """The last year is partial as of 2001-08: its count is carried to twelve months."""
    return _yearly(s, d).select("year", F.round(F.when(F.col("year") == 2001, F.col("n") * (12.0 / 7)).otherwise(F.col("n").cast("double")), 6).alias("annual"))


@query(f"""WITH {TRADE_SQL}, v AS (SELECT entity, year, docs, row_number() OVER (PARTITION BY year ORDER BY docs DESC, entity) AS rank FROM dense), t AS (SELECT entity, rank FROM v WHERE rank <= 40 AND docs > 0 AND year BETWEEN 1996 AND 2000)
SELECT entity, n::BIGINT AS runs_seen, list_aggregate(list_concat(rs, list_transform(range(5 - n), lambda x: 41::DOUBLE)), 'median') AS rank_median, mn::INT AS rank_min, mx::INT AS rank_max, n * 2 >= 5 AS stable FROM (SELECT entity, count(*) AS n, list(rank::DOUBLE) AS rs, min(rank) AS mn, max(rank) AS mx FROM t GROUP BY 1)""")
def stability_ranks(s, d):
    ranked = rank.top_per(_series(s, d), ["year"], [F.desc("docs"), F.asc("entity")], 40).where((F.col("docs") > 0) & F.col("year").between(1996, 2000))
    return history.rank_stability(ranked, 5, 40)


@query(f"""WITH {TRADE_SQL}, ndf AS (SELECT entity, count(*) AS df FROM names GROUP BY ALL), t AS (SELECT doc_id, year, entity FROM names JOIN ndf USING (entity) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, entity) <= 25),
p AS (SELECT a.entity AS a, b.entity AS b, a.year FROM t a JOIN t b USING (doc_id) WHERE a.entity < b.entity AND len(list_intersect(string_split(a.entity, ' '), string_split(b.entity, ' '))) = 0),
g AS (SELECT a, b, count(*) FILTER (year BETWEEN 1999 AND 2001)::BIGINT AS r, count(*) FILTER (year BETWEEN 1995 AND 1997)::BIGINT AS base FROM p GROUP BY ALL)
SELECT a, b, r, base, round(log2((r + 1) / (base + 1)), 6) + 0.0 AS growth, round(least(log2((r + 1) / (base + 1)), 8) - 0.5 * log10(greatest(r / 200, 1)), 6) + 0.0 AS score FROM g WHERE r >= 1 AND log2((r + 1) / (base + 1)) >= 0.5""")
def pair_growth(s, d):
    names = trade_names(s, d)
    df = names.groupBy("entity").agg(F.count(F.lit(1)).alias("df"))
    got = pairs.pair_growth(pairs.pairs(pairs.rarest(names, df)), TRADE, 1, 0.5)
    return got.select("a", "b", "r", "base", (F.round("growth", 6) + F.lit(0.0)).alias("growth"), (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query(f"WITH {_ALL} SELECT entity, volume::BIGINT AS volume, round(growth, 6) AS growth FROM scored WHERE volume >= 5 AND coalesce(growth, 0) <= 0.3")
def established_terms(s, d):
    rows = score.volumes(window_sums(s, d)).join(score.growth(window_sums(s, d)), "entity")
    return pairs.established(rows, 5, 0.3).select("entity", "volume", F.round("growth", 6).alias("growth"))


@query(f"WITH {TRADE_SQL}, w AS (SELECT entity AS key, grp, doc_id, source FROM found) SELECT key, count(DISTINCT source)::BIGINT AS companies, count(DISTINCT source) FILTER (o_orderdate >= TIMESTAMP '2000-01-01')::BIGINT AS funded_recent, round(sum(o_totalprice), 2) AS amount, strftime(min(o_orderdate), '%Y-%m-%d') AS first_raise FROM w JOIN orders ON o_orderkey = doc_id GROUP BY ALL")
def funding_rollup(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("at"))
    rows = trade_found(s, d).join(o, "doc_id").select(F.col("entity").alias("key"), F.col("source").alias("company"), "amount", "at")
    return pairs.funding(rows, F.lit("2000-01-01").cast("timestamp_ntz")).select("key", "companies", "funded_recent", F.round("amount", 2).alias("amount"), F.date_format("first_raise", "yyyy-MM-dd").alias("first_raise"))


@query("""WITH w AS (SELECT p_brand AS key, s_name AS org, n_name AS country FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
o AS (SELECT key, org, country, count(*) AS works FROM w GROUP BY ALL), t AS (SELECT key, string_agg(org, ',' ORDER BY works DESC, org) AS best FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY works DESC, org) <= 6) GROUP BY ALL)
SELECT key, count(DISTINCT org)::BIGINT AS n_orgs, count(DISTINCT country)::BIGINT AS n_countries, round(coalesce(sum(works) FILTER (country = 'CHINA'), 0) / sum(works), 6) AS country_share, best FROM o JOIN t USING (key) GROUP BY key, best""")
def actors_topk(s, d):
    sup = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("org"), F.col("n_name").alias("country"))
    rows = table(s, d, "lineitem").select("l_partkey", "l_suppkey").join(table(s, d, "part").select("p_partkey", F.col("p_brand").alias("key")), F.col("l_partkey") == F.col("p_partkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    return pairs.actors(rows.select("key", "org", "country"), "CHINA").withColumn("country_share", F.round("country_share", 6))


@query(f"""WITH {TRADE_SQL}, r AS (SELECT source || '/' || grp AS key, year, round(o_totalprice, 2) AS money, doc_id AS project FROM docs JOIN orders ON o_orderkey = doc_id),
t AS (SELECT key, string_agg(project::VARCHAR, ',' ORDER BY year DESC, money DESC, project) AS best FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY year DESC, money DESC, project) <= 5) GROUP BY ALL)
SELECT key, count(*)::BIGINT AS total, count(*) FILTER (year BETWEEN 1999 AND 2001)::BIGINT AS recent, count(*) FILTER (year BETWEEN 1995 AND 1997)::BIGINT AS base, min(year)::INT AS first, round(sum(money), 2) AS money, best FROM r JOIN t USING (key) GROUP BY key, best""")
def project_rollup(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("project"), F.round("o_totalprice", 2).alias("money"))
    rows = trade_docs(s, d).withColumnRenamed("doc_id", "project").join(o, "project").select(F.concat_ws("/", "source", "grp").alias("key"), "year", "money", "project")
    return pairs.projects(rows, TRADE).withColumn("money", F.round("money", 2))


@query(f"WITH {TRADE_SQL}, a AS (SELECT entity, sum(df)::BIGINT AS n FROM cube WHERE source = 'BUILDING' GROUP BY ALL), b AS (SELECT entity, sum(df)::BIGINT AS n FROM cube WHERE source = 'MACHINERY' GROUP BY ALL) SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.n, 0)::BIGINT AS building, coalesce(b.n, 0)::BIGINT AS machinery FROM a FULL JOIN b ON a.entity = b.entity")
def full_outer_layers(s, d):
    c = _cube(s, d)
    side = lambda name, out: c.where(F.col("source") == name).groupBy("entity").agg(F.sum("df").alias(out))
    return side("BUILDING", "building").join(side("MACHINERY", "machinery"), "entity", "full").select("entity", F.coalesce("building", F.lit(0).cast("long")).alias("building"), F.coalesce("machinery", F.lit(0).cast("long")).alias("machinery"))


@query(f"WITH {TRADE_SQL}, k AS (SELECT DISTINCT entity FROM found WHERE year = 2001) SELECT DISTINCT entity, 'known' AS side FROM found SEMI JOIN k USING (entity) WHERE year = 1995 UNION ALL SELECT DISTINCT entity, 'gone' FROM found ANTI JOIN k USING (entity) WHERE year = 1995")
def semi_anti_keys(s, d):
    f = trade_found(s, d).select("entity", "year")
    k, old = f.where("year = 2001").select("entity").distinct(), f.where("year = 1995").select("entity").distinct()
    return old.join(k, "entity", "left_semi").withColumn("side", F.lit("known")).unionByName(old.join(k, "entity", "left_anti").withColumn("side", F.lit("gone")))


@query(f"WITH {TRADE_SQL}, v AS (SELECT entity, grp, df FROM groups) SELECT entity, arg_min(grp, row(-df, grp)) AS domain FROM v GROUP BY ALL")
def domain_of(s, d):
    return _groups(s, d)[0].groupBy("entity").agg(F.min_by("grp", F.struct(-F.col("df"), F.col("grp"))).alias("domain"))


@query(f"""WITH {TRADE_SQL}, v AS (SELECT entity, sum(docs)::BIGINT AS v FROM dense GROUP BY ALL), r AS (SELECT entity, v, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2) / count(*) OVER () AS pct FROM v) SELECT entity, round(pct, 6) AS pct FROM r""")
def pct_rank_avg(s, d):
    v = _series(s, d).groupBy("entity").agg(F.sum("docs").alias("v"))
    return rank.percentile_ranked(v, "v").select("entity", F.round("pct", 6).alias("pct"))


@query(f"""WITH {TRADE_SQL}, v AS (SELECT entity, entity % 7 AS area, sum(docs)::BIGINT AS v FROM dense GROUP BY ALL), r AS (SELECT *, (rank() OVER (PARTITION BY area ORDER BY v) + (count(*) OVER (PARTITION BY area, v) - 1) / 2) / count(*) OVER (PARTITION BY area) AS pct FROM v) SELECT entity, area::BIGINT AS area, v, round(pct, 6) AS pct FROM r WHERE pct >= 1 - 0.25""")
def area_quota(s, d):
    v = _series(s, d).groupBy("entity").agg(F.sum("docs").alias("v")).select("entity", (F.col("entity") % 7).alias("area"), "v")
    return rank.area_quota(v, "area", "v", 0.25).withColumn("pct", F.round("pct", 6))


@query(f"""WITH {TRADE_SQL}, v AS (SELECT entity, entity % 7 AS area, sum(docs)::BIGINT AS v FROM dense GROUP BY ALL), e AS (SELECT entity, v FROM v QUALIFY row_number() OVER (PARTITION BY area ORDER BY v DESC, entity) <= 3), a AS (SELECT entity, v FROM v ORDER BY v DESC, entity LIMIT 30)
SELECT entity, CASE WHEN entity IN (SELECT entity FROM e) THEN 'group' ELSE 'all' END AS source, v FROM (SELECT * FROM e UNION SELECT * FROM a)""")
def top_per_area_union(s, d):
    v = _series(s, d).groupBy("entity").agg(F.sum("docs").alias("v")).select("entity", (F.col("entity") % 7).alias("area"), "v")
    return rank.top_union(v, "area", "v", "entity", 3, 30)


@query(f"""WITH {TRADE_SQL}, v AS (SELECT entity, entity % 7 AS head, sum(docs)::DOUBLE AS v FROM dense GROUP BY ALL), a AS (SELECT *, round(v * pow(0.55, row_number() OVER (PARTITION BY head ORDER BY v DESC, entity) - 1), 9) AS adjusted FROM v) SELECT entity, head::BIGINT AS head, v, round(adjusted, 6) AS adjusted, row_number() OVER (ORDER BY adjusted DESC, entity)::INT AS place FROM a""")
def diversify(s, d):
    v = _series(s, d).groupBy("entity").agg(F.sum("docs").cast("double").alias("v")).select("entity", (F.col("entity") % 7).alias("head"), "v")
    return rank.diversified(v, "v", "head", "entity").withColumn("adjusted", F.round("adjusted", 6))


_LABELLED = """labelled AS (SELECT a.entity, a.n AS score, coalesce(b.n, 0) >= a.n AS y FROM (SELECT entity, sum(docs) AS n FROM dense WHERE year <= 1998 GROUP BY ALL) a LEFT JOIN (SELECT entity, sum(docs) AS n FROM dense WHERE year > 1998 GROUP BY ALL) b USING (entity))"""


def _labelled(s, d):
    r = _series(s, d).groupBy("entity").agg(F.sum(F.when(F.col("year") <= 1998, F.col("docs")).otherwise(0)).alias("score"), F.sum(F.when(F.col("year") > 1998, F.col("docs")).otherwise(0)).alias("later"))
    return r.select("entity", "score", (F.col("later") >= F.col("score")).alias("y"))


@query(f"WITH {TRADE_SQL}, {_LABELLED}, r AS (SELECT y::INT AS y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM labelled) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6)::DOUBLE AS auc FROM r")
def rank_auc(s, d):
    return rank.rank_auc(_labelled(s, d), "score", "y").select(F.round("auc", 6).alias("auc"))


@query(f"WITH {TRADE_SQL}, {_LABELLED}, t AS (SELECT * FROM labelled ORDER BY score DESC, entity LIMIT 30), b AS (SELECT avg(y::INT) AS base, sum(y::INT) AS p FROM labelled) SELECT round(avg(y::INT), 6) AS precision, round(any_value(base), 6) AS base, round(avg(y::INT) / any_value(base), 6) AS lift, round(sum(y::INT) / any_value(p), 6) AS recall FROM t, b")
def backtest_top30(s, d):
    return rank.precision_lift(_labelled(s, d), "score", "y", "entity", 30).select(*[F.round(c, 6).alias(c) for c in ("precision", "base", "lift", "recall")])


@query(f"WITH {TRADE_SQL}, {_LABELLED}, n AS (SELECT ntile(10) OVER (ORDER BY score, entity) AS decile, y FROM labelled) SELECT decile::INT AS decile, count(*)::BIGINT AS n, round(avg(y::INT), 6) AS rate FROM n GROUP BY ALL")
def calibration_deciles(s, d):
    from pyspark.sql import Window as W

    return _labelled(s, d).withColumn("decile", F.ntile(10).over(W.partitionBy(F.lit(0)).orderBy("score", "entity"))).groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("y").cast("double")), 6).alias("rate"))


@query(f"WITH {TRADE_SQL}, {_LABELLED}, q AS (SELECT entity AS query, CASE WHEN y THEN row_number() OVER (ORDER BY score DESC, entity) % 15 + 1 END AS rank FROM labelled) SELECT round(avg(coalesce(rank <= 10, false)::INT), 6) AS recall, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg FROM q")
def recall_mrr(s, d):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "entity"))
    ranks = _labelled(s, d).select(F.col("entity").alias("query"), F.when(F.col("y"), place % 15 + 1).alias("rank"))
    return rank.retrieval_metrics(ranks).select(*[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query("""WITH m AS (SELECT p_brand AS card, l_orderkey AS doc_id FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), n AS (SELECT card, count(*) AS n FROM m GROUP BY ALL)
SELECT x.card AS a, y.card AS b, count(*)::BIGINT AS shared, round(count(*) / least(any_value(na.n), any_value(nb.n)), 6) AS overlap FROM m x JOIN m y USING (doc_id) JOIN n na ON na.card = x.card JOIN n nb ON nb.card = y.card WHERE x.card < y.card GROUP BY 1, 2 HAVING count(*) / least(any_value(na.n), any_value(nb.n)) >= 0.05""")
def set_overlap(s, d):
    m = table(s, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("doc_id")).join(table(s, d, "part").select("p_partkey", F.col("p_brand").alias("card")), F.col("l_partkey") == F.col("p_partkey")).select("card", "doc_id").distinct()
    return pairs.set_overlap(m, 0.05).withColumn("overlap", F.round("overlap", 6))
