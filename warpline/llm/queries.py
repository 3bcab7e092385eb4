"""The thin queries of this subpackage and their SQL; each reads whole tables and gives whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.llm.common import among
from warpline.llm.cover_tree import TOP_SQL, top_products
from warpline.llm.embedding_dedup import GROUPS_SQL, embedding_groups
from warpline.llm.language_id import identify_languages
from warpline.llm.line_dedup import deduplicate_lines
from warpline.llm.mixing import MIX_SQL, mix_sources
from warpline.llm.packing import pack_documents
from warpline.llm.pii import KINDS, personal_data
from warpline.llm.secrets import BASE, joined_spans, secret_spans
from warpline.llm.simhash_dedup import simhash_groups
from warpline.llm.toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the rows that labels may be learned from; of labels that disagree the toxic one holds."""
    own = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = among(docs.where(crc_fold("doc_id", 5) != 0).select("doc_id", "text"), F.col("doc_id"), own, F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    # A merge join whatever the size, so that the plan does not change as labels outgrow a broadcast.
    return rows.join(own.hint("merge"), "doc_id")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = joined_spans(F.col("base"))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined_spans(F.concat("base", "added")).alias("spans"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = identify_languages(docs, crc_fold("doc_id", 4) != 2)
    return rows.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), digest=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = toxicity_scores(docs.select("doc_id", "text"), labelled_documents(docs, labels), crc_fold("doc_id", 5) == 4)
    return rows.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed and the text that stays; runs as lo:hi, comma-joined."""
    rows = deduplicate_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.array_join(F.transform("_runs", lambda r: F.concat_ws(":", r["lo"], r["hi"])), ",")
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), runs.alias("runs"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_simhash_near_dedup, op3_personal_data, op4_exact_top_k, op5_language_id,
        op6_packing, op7_toxicity, op8_source_mixing, op9_secret_scan, op10_line_dedup,
    )
}
SQL = {"op1_embedding_near_dedup": GROUPS_SQL, "op4_exact_top_k": TOP_SQL, "op8_source_mixing": MIX_SQL}
