"""Rules on names, addresses, trust and claims: expected values worked out by hand, and greedy choices by plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.functions import names as N
from glimmer.functions import text as X
from glimmer.functions import urls as U
from glimmer.operators import base, claims, grouping, rank
from glimmer.operators import evidence as E
from glimmer.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_all_boundary_words_cut(spark):
    got = one(spark, X.chunks(F.lit("A proposed photonic chip against efficiently cooled racks, application of kv caches and 2024 3 results 402 gpus")))
    assert got == [["photonic", "chip"], ["efficiently", "cooled", "racks"], ["kv", "caches"], ["gpus"]]


@pytest.mark.parametrize("text, want", [("word 5 7 9 next", [["word", "5"], ["next"]]), ("http 402 2024 7 x", [["http", "402"], ["x"]]), ("8 bit 8-bit", [["bit", "8", "bit"]]), ("state-of-the-art compute-in-memory chip", [["compute_in_memory", "chip"]])])
def test_numbers_and_chains(spark, text, want):
    assert one(spark, X.chunks(F.lit(text))) == want


@pytest.mark.parametrize("phrase, want", [("unlocking high", True), ("long horizon autonomous", True), ("time series models", False), ("multi agent systems", False), ("multi agent autonomous", True), ("photonic chip", False), ("bandwidth memory", True)])
def test_fragments(spark, phrase, want):
    assert one(spark, X.is_fragment(F.lit(phrase))) is want


@pytest.mark.parametrize("phrase, want", [("symmetry engineered", True), ("crystal optics", False), ("surface physics", False), ("federated learning", True), ("thermal", False), ("electrically", True)])
def test_adjective_heads(spark, phrase, want):
    assert one(spark, X.adjective_head(F.lit(phrase))) is want


@pytest.mark.parametrize("a, b", [("ai-powered fraud boxes", "fraud box"), ("novel data caches", "data cach"), ("smart batteries", "battery")])
def test_merge_key(spark, a, b):
    assert one(spark, X.merge_key(F.lit(a))) == one(spark, X.merge_key(F.lit(b)))


@pytest.mark.parametrize(
    "phrase, want",
    [
        ("mining waste sensor", None), ("weak optical signal", None), ("deploying ai agents", "gerund"), ("openai agents", "brand"), ("awesome list tools", "furniture"),
        ("one two three four five", "length"), ("a b", "short_tokens"), ("sensor fusion optical", "adjective"), ("quantum market", "discourse"), ("meta ai system", "ambiguous_brand"),
        ("ai system", "nothing_specific"), ("horizon scanning", "meta_concept"), ("red sensor fusion", "excluded"), ("sensor api", None),
    ],
)
def test_assessment(spark, phrase, want):
    got = one(spark, N.assessed(F.lit(phrase), F.lit(0.7), exclusions=F.array(F.lit("red"))))
    assert got["reason"] == want


@pytest.mark.parametrize("phrase, want", [("financial ai", 0.65), ("sensor api", 0.75), ("spark streaming sensor", 0.85), ("key management", 0.65), ("quantum sensor", 1.0)])
def test_specificity(spark, phrase, want):
    assert one(spark, N.assessed(F.lit(phrase), F.lit(0.7)))["specificity"] == pytest.approx(want)


@pytest.mark.parametrize("url, want", [("https://ir.reuters.com/x", "reuters.com"), ("https://a.b.co.uk", "b.co.uk"), ("http://shop.x.com.tr:80/", "x.com.tr"), ("https://x.com", "x.com")])
def test_registrable_domain(spark, url, want):
    assert one(spark, U.registrable_domain(F.lit(url))) == want


@pytest.mark.parametrize("url, want", [("https://codeberg.org/Org/repo", "codeberg.org:org"), ("https://gitverse.ru/a", "gitverse.ru:a"), ("https://github.com", "github.com"), ("https://example.com/a", None)])
def test_code_origin(spark, url, want):
    assert one(spark, U.code_origin(F.lit(url))) == want


def test_doi_without_its_last_dot(spark):
    assert one(spark, U.doi(F.lit("https://doi.org/10.1145/AB.12."))) == "10.1145/ab.12" and one(spark, U.doi_registrant(F.lit("doi:10.1145/x"))) == "10.1145"


@pytest.mark.parametrize("name, want", [("Acme, L.L.C.", "acme"), ("Beta GmbH", "beta gmbh"), ("Gamma Group PBC", "gamma group"), (None, "")])
def test_company_names(spark, name, want):
    assert one(spark, X.company_name(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize("url, kind, name, want", [("https://www.vedomosti.ru/a", "other", "", "B"), ("https://europa.eu/x", "blog", "", "A"), ("https://x.com/1", "other", "Reuters.com", "B"), ("https://x.com/1", "paper", "PRNewswire", "C"), ("https://x.com/1", "other", "", "U")])
def test_trust(spark, url, kind, name, want):
    assert one(spark, E.trust_tier(F.lit(url), F.lit(kind), F.lit(name))) == want


def test_one_text_in_communities_is_one_piece(spark):
    key = lambda family, url: one(spark, E.independence_key(F.lit(family), F.lit(url), F.lit("The new chip says a report")))
    assert key("community", "https://a.com") == key("media", "https://b.com") == "syndicated|chip"
    assert key("science", "https://doi.org/10.1145/1") == "science|doi:10.1145|chip"


def test_versions_of_a_work_are_one(spark):
    base_title, more = "Adaptive photonic control for quantum sensors", ": a scalable experimental architecture"
    docs = [(1, "science", "https://doi.org/10.1145/1", base_title, "", "B"), (2, "science", "https://doi.org/10.9999/7", base_title + more, "", "A"), (3, "science", "https://arxiv.org/abs/1", "Adaptive photonic control for quantum sensing sensors", "", "B"), (4, "science", "https://arxiv.org/abs/2", "Adaptive photonic control: integrated arrays of light", "", "B"), (5, "media", "https://a.com/1", "Chip news today", "", "C"), (6, "press", "https://b.com/1", "New chip news today", "", "B"), (7, "code", "https://github.com/x/y", base_title, "", "B")]
    got = E.independent_documents(spark.createDataFrame(docs, "id int, family string, url string, title string, source_name string, tier string"))
    assert sorted(r["id"] for r in got.collect()) == [2, 4, 6, 7]


@pytest.mark.parametrize(
    "title, own, canon, merged, attached, want",
    [
        ("Edge computings for all", "edge computing", None, [], None, "direct"),
        ("Cutting-edge computing", "edge computing", None, [], None, "NOT_NAMED"),
        ("Edge-computing at last", "edge computing", None, [], None, "direct"),
        ("Vibecoding tools", "vibe coding", None, [], None, "glued"),
        ("Homomorphic encryption", "quantum key distribution", "homomorphic encryption", [], None, "NOT_NAMED"),
        ("Computing edge cases", "edge computing", "computing edge", [], None, "direct"),
        ("On something else", "edge computing", None, ["edge ai"], "edge ai", "ATTACHMENT_NOT_AUTHORITATIVE"),
        ("Edge computing", "edge computing", None, ["edge ai"], "edge ai", "direct"),
        ("О краевых вычислениях", "edge computing", None, [], None, "CROSS_LANGUAGE_UNVERIFIED"),
        ("", "edge computing", None, [], None, "NO_TITLE"),
        ("Any", "the of", None, [], None, "NO_AUTHORITATIVE_NAME"),
        ("Any", "", None, [], None, "IDENTITY_NOT_DEFINED"),
    ],
)
def test_claims(spark, title, own, canon, merged, attached, want):
    rows = spark.createDataFrame([(title, own, canon, merged, attached)], "t string, o string, c string, m array<string>, a string")
    assert rows.select(claims.claim_state(*[F.col(c) for c in "tocma"]).alias("x")).first()["x"] == want


def test_groups_and_second_list_are_the_plain_loops(spark):
    rng = np.random.default_rng(11)
    ids = list(range(80))
    near = {tuple(sorted(map(int, p))) for p in rng.integers(0, 80, (150, 2)) if p[0] != p[1]}
    order = [int(x) for x in rng.permutation(80)]
    items = spark.createDataFrame([(i, order.index(i)) for i in ids], "id int, rank int")
    conflicts = spark.createDataFrame(sorted(near), "a int, b int")
    touch = lambda a, b: tuple(sorted((a, b))) in near
    leaders, led = [], {}
    for i in order:
        led[i] = next((j for j in leaders if touch(i, j)), i)
        if led[i] == i:
            leaders.append(i)
    assert {r["id"]: r["leader"] for r in grouping.grouped(items, conflicts).collect()} == led
    shown, extra = order[:5], []
    for i in order[5:]:
        if not any(touch(i, j) for j in shown + extra):
            extra.append(i)
    got = grouping.extra_list(items, spark.createDataFrame([(i,) for i in shown], "id int"), conflicts, 10)
    assert [r["id"] for r in got.orderBy("place").collect()] == extra[:10]


def test_contained_phrases(spark):
    rows = ["on-policy distillation", "policy distillation", "policy", "olicy dis", "other"]
    got = {(r["a"], r["b"]) for r in grouping.contained(spark.createDataFrame([(x,) for x in rows], "phrase string")).collect()}
    want = {(a, b) for a in rows for b in rows if a != b and a.replace("-", " ") in b.replace("-", " ")}
    assert got == want


def test_filings_and_forecasts(spark):
    issuers = spark.createDataFrame([("1", "A Inc", "YES"), ("2", "B", "YES"), ("3", "C", "YES"), ("4", "D", "NO"), ("5", "E", "YES")], "ACCESSIONNUMBER string, ENTITYNAME string, IS_PRIMARYISSUER_FLAG string")
    offers = spark.createDataFrame([("1", "10", None, None), ("2", "5", "true", None), ("3", "x", "false", "TRUE"), ("4", "1", None, None), ("5", "Indefinite", None, None)], "ACCESSIONNUMBER string, TOTALAMOUNTSOLD string, ISAMENDMENT string, ISPOOLEDINVESTMENTFUNDTYPE string")
    subs = spark.createDataFrame([(str(i), "05-Mar-2024" if i != 5 else None) for i in range(1, 6)], "ACCESSIONNUMBER string, FILING_DATE string")
    assert [(r["company"], r["amount"]) for r in readers.form_d(issuers, offers, subs).collect()] == [("a", 10.0)]
    yearly = spark.createDataFrame([("t", y, n) for y, n in ((2021, 9), (2023, 30), (2024, 60), (2025, 90))], "technology string, year int, n int")
    made = spark.createDataFrame([("t", 2020, 10.0), ("t", 2021, 10.0), ("t", 2024, 10.0)], "technology string, year int, baseline double")
    got = {r["year"]: (r["outcome"], r["hit"]) for r in sinks.scored_forecasts(made, yearly, 2026).collect()}
    assert got == {2020: (60.0, True), 2021: (75.0, True), 2024: (None, None)}


def test_quotes_and_passports(spark):
    about = lambda p, q, s=0.0: one(spark, base.quote_is_about(F.lit(p), F.lit(q), F.lit(s)))
    assert about("edge caches", "a new edge cache is piloted") and not about("edge caches", "an orbital laser") and about("ai system", "anything") and about("edge caches", "", 0.4)
    rows = spark.createDataFrame([(1, "combo", True, 1.0, 0.0), (2, "combo", True, 2.0, 0.0), (3, "combo", False, 9.0, 0.0), (4, "base", False, 0.0, 0.5), (5, "base", None, 0.0, 0.5)], "id int, kind string, confirmed boolean, growth double, expert double")
    assert {r["id"]: round(r["score"], 6) for r in base.passport_scores(rows).collect()} == {1: 0.75, 2: 0.95, 4: 0.35, 5: 0.5}


def test_whole_table_quantiles_and_places(spark):
    v = np.random.default_rng(2).integers(0, 40, 501).astype(float)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    points = [0.0, 0.025, 0.5, 0.777, 0.95, 1.0]
    assert np.allclose(rank.quantiles(rows, "v", points, 16).first()["q"], np.quantile(v, points))
    got = [r["i"] for r in rank.numbered(rows.repartition(7), [F.col("v"), F.col("i")], "n").orderBy("n").collect()]
    assert got == sorted(range(501), key=lambda i: (v[i], i))
