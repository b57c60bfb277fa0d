"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from foliant import deal_queries, queries, source_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)

    def show(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return cols, sorted("|".join(map(show, r)) for r in frame[cols].astype(object).values.tolist())


QUICK = ["mask_profile", "money_roundtrip", "percent_roundtrip", "date_roundtrip", "class_names", "running_lines", "total_reconcile", "field_scores", "bag_overlap", "ordinal_prefix", "work_list", "span_status", "top_tables", "item_blocks", "mask_map_values", "nested_pii", "main_list", "stated_facts", "cited_facts", "tranche_terms", "unparsed_tranches", "trigger_terms", "coverage_terms", "uncited_facts", "score_gate", "styled_lists", "lists_and_tables", "page_numbers", "quoted_items", "masked_texts", "page_ranges", "region_tables", "span_chains", "quoted_words", "citation_lookup", "answer_violations", "kept_calls", "mask_payloads"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert rows(got) == rows(sql.execute(queries.ORACLE_SQL[name]).fetchdf())


def test_every_sql_has_its_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")
def test_citation_keys_of_all_documents(spark, sql):
    got = queries.QUERIES["citation_keys"](spark, DATA).toPandas()
    assert len(got) == sql.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert rows(got) == rows(sql.execute(queries.ORACLE_SQL["citation_keys"]).fetchdf())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")
def test_payment_lists_of_all_parts(spark, sql):
    got = queries.QUERIES["payment_lists"](spark, DATA).toPandas()
    assert got.n_steps.sum() == sql.execute("SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)").fetchone()[0]
    assert rows(got) == rows(sql.execute(queries.ORACLE_SQL["payment_lists"]).fetchdf())
