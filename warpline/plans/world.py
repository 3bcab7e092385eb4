"""Stand-in records over the test tables, so that every operator has real input.

The same rules are given as SQL (``WORLD_SQL``) for the oracles. Documents are dealt by their id:
drafts of a law (0), proposed changes (1 to 4), consultation documents (5 to 8) and provisions of the
final text (9), to which the benchmark passages belong too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.session import spread

#: Tables whose rows are texts: a small file of them holds much work.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def _id(prefix: str, column: str = "doc_id") -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _day(offset: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), offset.cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, stage, text): provisions of the proposal and of the final act."""
    docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    stage = F.when(F.col("doc_id") % 10 == 9, "final_act").otherwise("proposal")
    own = docs.where("doc_id % 10 in (0, 9)").select(_id("d:").alias("article_id"), stage.alias("stage"), "text")
    return own.unionByName(passages.select(_id("b:", "item_id").alias("article_id"), F.lit("final_act").alias("stage"), "text"))


def amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(amendment_id, author_id, author_group, stage, committee, tabled_on, old_text, new_text)."""
    d, author = F.col("doc_id"), F.col("doc_id") % 23
    return table(spark, sf_dir, "documents").where("doc_id % 10 between 1 and 4").select(
        _id("am:").alias("amendment_id"),
        F.concat(F.lit("m"), author.cast("string")).alias("author_id"),
        F.when(author % 11 != 0, F.concat(F.lit("g"), (author % 5).cast("string"))).alias("author_group"),
        F.when(d % 2 == 0, "committee").otherwise("plenary").alias("stage"),
        F.col("source").alias("committee"),
        F.when(d % 29 != 0, _day(d % 30)).alias("tabled_on"),
        F.lit(None).cast("string").alias("old_text"),
        F.col("text").alias("new_text"),
    )


def consultations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, published_on, organisation, text); a citizen's document names no organisation."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").where("doc_id % 10 between 5 and 8").select(
        _id("c:").alias("document_id"), F.when(d % 31 != 0, _day((7 * d) % 30)).alias("published_on"), F.when(d % 17 != 0, F.col("source")).alias("organisation"), "text"
    )


TOKEN_SQL = r"(\p{Nd}+(?:[.,]\p{Nd}+)*%?|[\p{L}\p{N}_]+)"


def words_sql(text: str) -> str:
    """Folded words of an SQL text expression, as a list."""
    return (
        f"list_transform(list_filter(regexp_extract_all({text}, '{TOKEN_SQL}', 1), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')), "
        "lambda w: replace(lower(w), 'ß', 'ss'))"
    )


def windows_sql(source: str, keys: str) -> str:
    """Rows (keys, place_, gram) of all windows of the lists ``w`` in a relation."""
    return f"select {keys}, place_, array_to_string(w[place_ + 1:place_ + 8], ' ') as gram from (select *, unnest(range(0, greatest(len(w) - 7, 0)))::int as place_ from {source}) x"


#: Common table expressions for the world, from ``articles`` to windows; an oracle goes on from there.
WORLD_SQL = f"""
articles as (
    select 'd:' || doc_id as article_id, case when doc_id % 10 = 9 then 'final_act' else 'proposal' end as stage, text, {words_sql("text")} as w from documents where doc_id % 10 in (0, 9)
    union all
    select 'b:' || item_id, 'final_act', text, {words_sql("text")} from benchmark
), amendments as (
    select 'am:' || doc_id as amendment_id, 'm' || (doc_id % 23) as author_id, case when doc_id % 23 % 11 <> 0 then 'g' || (doc_id % 23 % 5) end as author_group,
        case when doc_id % 2 = 0 then 'committee' else 'plenary' end as stage, source as committee,
        case when doc_id % 29 <> 0 then date '2024-01-01' + (doc_id % 30)::int end as tabled_on, text as new_text, {words_sql("text")} as w
    from documents where doc_id % 10 between 1 and 4
), consultations as (
    select 'c:' || doc_id as document_id, case when doc_id % 31 <> 0 then date '2024-01-01' + ((7 * doc_id) % 30)::int end as published_on,
        case when doc_id % 17 <> 0 then source end as organisation, text, {words_sql("text")} as w
    from documents where doc_id % 10 between 5 and 8
), proposal_grams as (
    select distinct gram from ({windows_sql("(select * from articles where stage = 'proposal')", "article_id")})
), novel as (
    select f.* from ({windows_sql("(select * from articles where stage = 'final_act')", "article_id")}) f where gram not in (select gram from proposal_grams)
), common_words as (
    select word from (select distinct article_id, unnest(w) as word from articles) group by word
    having count(*) >= greatest(2.0, 0.05 * (select count(*) from articles))
)
"""
