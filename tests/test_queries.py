"""Every registered query against its SQL on the smallest tables."""

import pytest

from helpers import SF, duck, same
from glimmer.plans.catalog import ORACLES, QUERIES

#: Panels that are empty at the smallest scale.
MAY_BE_EMPTY = {"pair_growth", "burst_terms"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert same(got, duck(ORACLES[name]))
    assert len(got) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 15
    assert set(e.oracle_sql()) <= set(e.queries())


_URL, _SLUG = "https://www.a.org/en/chip-news_today.html", "chip news today"


@pytest.mark.parametrize(
    "pages, want",
    [
        ([(1, _URL), (4, _URL), (5, _URL), (6, _URL), (9, _URL)], [(1, _SLUG, 2016), (4, _SLUG, 2019), (5, _SLUG, 2020), (9, "T9", 2024)]),
        ([(-1, _URL), (-2, _URL + "/"), (-3, _URL), (-4, _URL), (-5, _URL)], [(-1, _SLUG, 2014), (-2, _SLUG, 2013), (-3, "T-3", 2012), (-4, _SLUG, 2011), (-5, _SLUG, 2010)]),
        ([(4, "http://b.net/x.html\n"), (13, "http://b.net/x/\n"), (16, "http://b.net//"), (20, "https://www.example.com/y"), (17, ""), (8, None), (None, _URL)], [(4, "x.html\n", 2019), (13, "\n", 2018), (16, "b", 2021)]),
    ],
    ids=["repeated URLs", "ids below zero", "line ends and nulls"],
)
def test_press_reader_gives_a_row_for_each_page(spark, tmp_path, pages, want):
    import duckdb

    spark.createDataFrame([(i, u, "") for i, u in pages], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["press_reader"](spark, str(tmp_path)).toPandas()
    assert same(got, con.execute(ORACLES["press_reader"]).df())
    assert sorted(got[["page_id", "title", "year"]].itertuples(index=False, name=None)) == sorted(want)
