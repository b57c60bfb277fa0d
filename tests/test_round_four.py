"""Plans and figures that must not grow faster than the input."""

import os

import pytest

from foliant import deal_queries, queries  # noqa: F401
from foliant.operators import quotes, regions, structure, waterfalls
from tests import deal

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@tables
def test_main_lists_are_neither_shuffled_nor_sorted(spark):
    _, run = plan(queries.QUERIES["main_list"](spark, DATA))
    assert run.count("Exchange hashpartitioning") == 1 and run.count(" Sort [") == 1


def test_few_quotes_shuffle_no_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "One  zinc plate"), (2, "zinc"), (3, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "zinc pl"), (2, "NC"), (3, "tin"), (4, None)], "k int, quote string")
    few = quotes.quoted_in(asked, docs, "k")
    assert "posexplode" not in few._jdf.queryExecution().toString()
    want = {(1, 1), (2, 1), (2, 2)}
    assert {tuple(r) for r in few.collect()} == want
    monkeypatch.setattr(quotes, "SCANNED", 0)
    assert {tuple(r) for r in quotes.quoted_in(asked, docs, "k").collect()} == want


def test_found_lists_are_not_aggregated(spark):
    b = deal.blocks(spark)
    run = waterfalls.list_waterfalls(b, structure.sections(b))._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in run and "MapInArrow" in run


def test_grid_sorts_once_an_axis(spark):
    words = spark.createDataFrame([("d", 1, "a", 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    run = regions.grid(words, ["doc_id", "page"])._jdf.queryExecution().executedPlan().toString()
    assert run.count(" Sort [") == 2
