"""Pools of a topic, judged lines, covering terms, areas with exceptions, ladders: values by hand or by a plain loop."""

import random

from pyspark.sql import functions as F

from glimmer.functions import names as N
from glimmer.operators import answers, base, claims, pools, rank
from glimmer.sources import sinks


def test_overlapping_dedup_is_the_plain_loop(spark):
    draw = random.Random(5)
    words = "edge chip model graph agent memory storage net".split()
    rows = {}
    while len(rows) < 150:
        rows[" ".join(draw.sample(words, draw.randint(1, 4)))] = (round(draw.random(), 6), draw.choice([0, 1, 2, 3, 8, 9, 16, 17, 33, 70, 140, 1000]))
    kept = []
    for term, (score, n) in sorted(rows.items(), key=lambda r: (-r[1][0], r[0])):
        w = set(term.split())
        if not any((term in s or s in term or len(w & set(s.split())) >= 0.5 * min(len(w), len(set(s.split())))) and abs(n - m) <= 0.5 * max(n, m) for s, m in kept):
            kept.append((term, n))
    got = base.overlapping_dedup(spark.createDataFrame([(t, *v) for t, v in rows.items()], "term string, score double, support int"))
    assert {r["term"] for r in got.collect()} == {t for t, _ in kept}


def test_echo_repeats_the_phrase(spark):
    cases = [("edge AI chip", True), ("Edge-AI chip — name: text", True), ("edge ai chip - x - y", True), ("edge ai chip-x", False), ("", False), (None, False), ("name — edge ai chip", False)]
    rows = spark.createDataFrame([(e,) for e, _ in cases], "e string").select(answers.echo_holds(F.col("e"), F.lit("Edge AI chip")).alias("ok"))
    assert [r["ok"] for r in rows.collect()] == [ok for _, ok in cases]


def test_quote_ignores_case_and_punctuation(spark):
    cases = [("A chip, for: edge", ["On a CHIP for-edge!"], True), ("chip for", ["a chip for edge"], False), ("", ["x"], False), (None, ["x"], False), ("a b c", None, False), ("Чип для края", ["новый чип для края сети"], True)]
    rows = spark.createDataFrame([(q, t) for q, t, _ in cases], "q string, t array<string>").select(answers.quote_holds(F.col("q"), F.col("t")).alias("ok"))
    assert [r["ok"] for r in rows.collect()] == [ok for *_, ok in cases]


def test_verified_lines_need_their_sources(spark):
    line = ("p", "p", True, True, True, True, "new", "one two three", "u", ["see one, two three"], ["u"])
    change = lambda **c: tuple(c.get(k, v) for k, v in zip("phrase echo signal on_topic verified confirm mass quote url titles urls".split(), line))
    cases = [(line, True), (change(confirm=None), False), (change(mass="массовая"), False), (change(mass=None), True), (change(quote="one two four"), False), (change(verified=False, confirm=False, quote=None), True), (change(on_topic=False), False)]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate([*cases, (change(signal=None), None), (change(echo="q"), None)])], "i int, phrase string, echo string, signal boolean, on_topic boolean, verified boolean, sources_confirm boolean, mass string, quote string, url string, titles array<string>, urls array<string>")
    assert {r["i"]: r["accepted"] for r in answers.checked(rows).collect()} == {i: ok for i, (_, ok) in enumerate(cases)}


def test_areas_with_exceptions(spark):
    lexicon = {"plain": r"\bchip", "strict": r"\bedge\b", "ruled": r"\bfactory\b", "named": r"\bbank\b"}
    rows = spark.createDataFrame([("a chip", "x", 0.0, []), ("edge_box", "x", 0.5, None), ("other", "x", 0.5, ["strict", "ruled"]), ("factory", "patient bank", 0.0, ["ruled"]), ("bank", None, None, [])], "name string, more string, share double, l array<string>")
    text = F.concat_ws(" ", "name", "more")
    found = N.areas(text, lexicon, {"plain": F.col("share"), "strict": F.col("share")}, F.col("l"), ("strict", "named"), never={"ruled": "patient"}, own_text={"named": F.col("name")})
    assert [r["a"] for r in rows.select(found.alias("a")).collect()] == [["plain"], ["plain", "strict"], ["plain", "strict", "ruled"], [], ["named"]]


def test_percentiles_by_group_are_pandas_ranks(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice("abc"), draw.choice([None, 1.0, 2.0, draw.random()])) for i in range(400)]
    got = rank.percentile_ranked(spark.createDataFrame(rows, "id int, g string, v double"), "v", by=("g",), buckets=4).toPandas().sort_values("id")
    want = got.groupby("g")["v"].rank(pct=True)
    assert ((got["pct"] - want).abs().fillna(0) < 1e-12).all() and (got["pct"].isna() == want.isna()).all()


def test_pools_of_empty_tables_are_empty(spark):
    none = spark.createDataFrame([], "area string, key long, semantic double, share double, learned double, hand double, relevance double, tagged boolean")
    assert pools.topic_orders(none.drop("relevance")).count() == 0
    assert pools.tagged_orders(none).count() == 0


def test_source_metrics_by_hand(spark):
    rows = [("a", y, n) for y, n in zip(range(1994, 2002), (3, 0, 3, 5, 5, 0, 4, 2))] + [("b", y, 0) for y in range(1994, 2002)]
    got = {r["entity"]: r for r in answers.source_metrics(spark.createDataFrame(rows, "entity string, year int, docs long"), 2001, 2.0).collect()}
    a, b = got["a"], got["b"]
    assert (a["total"], a["recent_mean"], a["prior_mean"], a["age"], a["peak_year"], a["peak_ratio"], a["last_share"]) == (22, 8 / 3, 2.0, 7, 1997, 5 / 6, 4 / 22)
    assert (b["total"], b["growth"], b["age"], b["peak_year"], b["peak_ratio"], b["last_share"]) == (0, 0.0, 0, None, 1.0, 0.0)


def test_ladder_and_largest_parts(spark):
    row = spark.range(1).select(sinks.ladder({"x": (F.lit(2), "works"), "y": (F.lit(0), "works"), "z": (F.lit(None).cast("long"), "works")}).alias("l"), sinks.largest(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(v).cast("double").alias("value")) for n, v in (("a", 0.1), ("b", -0.5), ("c", None), ("d", 0.5))]), 2).alias("t")).first()
    assert [tuple(x) for x in row["l"]] == [("x", True, "2 works"), ("y", False, "none"), ("z", False, "none")]
    assert [tuple(x) for x in row["t"]] == [("b", -0.5), ("d", 0.5)]


def test_documents_of_a_candidate(spark):
    papers = spark.createDataFrame([("edge chips", "w1", None, None, None, "preprint", "2024", None, "x" * 900, None), ("edge chips", "w2", "https://doi.org/10.1/a", "T", "J", "article", None, "de", None, "Chips edges")], "phrase string, id string, doi string, title string, venue string, kind string, published string, language string, text string, via string")
    code = spark.createDataFrame([("edge chips", "o/r", "d" * 300, "https://github.com/o/r", "", None, None)], "phrase string, full_name string, description string, url string, created string, stars int, via string")
    one, two, repo = claims.concrete_documents(papers, code, "2026", stale=True).collect()
    assert (one["title"], one["url"], one["source_name"], one["kind"], one["language"], len(one["snippet"]), one["attachment_source"], one["status"]) == ("", "w1", "OpenAlex", "preprint", "en", 700, "own", "STALE_CACHE")
    assert (two["url"], two["kind"], two["attachment_normalized"], two["attachment_source"], two["tier"]) == ("https://doi.org/10.1/a", "paper", "chip edge", "merged", "A")
    assert (len(repo["title"]), repo["published"], repo["stars"], repo["kind"], repo["tier"]) == (200, None, 0, "repository", "B")
