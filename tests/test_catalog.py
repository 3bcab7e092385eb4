"""Queries against their SQL on the smallest tables, where these are there."""

import os

import duckdb
import pytest

import __spark_entry__
from warpline import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "tokens_count", "word_offsets", "shingles8", "rarity_df", "adopted_phrases", "credits", "origin_matches", "tabled_phrases", "bm25_topk", "title_search", "group_interval", "funnel", "graph_edges", "review_summary", "procedure_catalog", "stage_dedupe",
    "input_hash", "lineage_counts", "consultation_documents", "dated_adoptions", "earlier_and_ratio", "node_search", "coverage_lines", "publications_of_law", "initiatives_by_title", "initiatives", "member_spells", "register_actors", "printed_dates",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.SQL[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(found)
    spark.catalog.clearCache()


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_entry(spark):
    assert "document_id" in __spark_entry__.entry(spark).columns
