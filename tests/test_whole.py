"""Queries over whole tables: against their SQL, or brute force."""

import os
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from warpline import catalog
from warpline.functions import text as T
from warpline.sources import documents

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "documents"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, FOLDER)
    found = con.execute(f"select {', '.join(df.columns)} from ({catalog.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert Counter(got) == Counter(found)
    return got


def test_law_is_resolved_for_all_orders(spark):
    got = against_sql(spark, "resolve_law")
    assert len(got) == spark.read.parquet(f"{FOLDER}/orders.parquet").count() and {r[1] for r in got} == {"chosen", "unknown"}


def test_summary_counts_misspelt_names(spark):
    tokens = F.array_join(F.array_sort(F.array_distinct(T.name_tokens(F.col("name")))), " ")
    entries = [(r.register_id, r.t) for r in catalog._entries(spark, FOLDER).select("register_id", F.explode("names").alias("name")).where("name is not null").select("register_id", tokens.alias("t")).collect()]
    mentions = catalog._mentions(spark, FOLDER).where("mention_id % 7 = 3").select(F.col("spelling").alias("name")).select(tokens.alias("t")).collect()
    expected = Counter({"register_id": 0, "mep_id": 0, "ambiguous": 0})
    for m in mentions:
        scores = {i: max(SequenceMatcher(None, m.t, t, autojunk=False).ratio() for j, t in entries if j == i) for i, _ in entries}
        best = [i for i, v in scores.items() if v == max(scores.values())]
        expected["unresolved" if max(scores.values()) < 0.9 else "fuzzy" if len(best) == 1 else "ambiguous"] += 1
    plain = Counter(r.resolution for r in catalog.QUERIES["resolve_exact"](spark, FOLDER).join(catalog._mentions(spark, FOLDER).where("mention_id % 7 <> 3"), "mention_id").where("coalesce(user_type, '') <> 'EU_CITIZEN'").collect())
    citizens = catalog._mentions(spark, FOLDER).where("user_type = 'EU_CITIZEN'").count()
    got = {r.method: r.actors for r in catalog.QUERIES["resolution_summary"](spark, FOLDER).collect()}
    assert mentions and got == {m: plain[m] + expected[m] + (citizens if m == "citizens" else 0) for m in got}
    assert sum(got.values()) == spark.read.parquet(f"{FOLDER}/supplier.parquet").count()


def test_pages_grow_with_the_table(spark):
    got = against_sql(spark, "feedback_pages")
    assert max(r[0] for r in got) > 7


def test_long_texts_are_extracted(spark):
    got = against_sql(spark, "extracted_text")
    assert sum(n > 5000 for _, _, n in got) > 0 and not any(c == "text_too_large" for _, c, _ in got)


def test_too_large_text(spark):
    rows = spark.createDataFrame([(1, "x" * documents.MOST_CHARACTERS), (2, "x" * (documents.MOST_CHARACTERS + 1))], "id int, t string").withColumn("content", F.encode("t", "utf-8"))
    assert {r.id: (r.code, r.characters) for r in documents.extract_text(rows).collect()} == {1: (None, 500_000), 2: ("text_too_large", None)}
