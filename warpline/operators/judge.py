"""The judged path: reworded requests, scored by whatever is plugged in; no network here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.operators.origins import eligibility, precedes

CUTOFF, CONTEXT, SHORT_CONTEXT, MOST_BYTES = 0.67, 1200, 300, 24_000


def requests(candidates: DataFrame, asks: DataFrame, amendments: DataFrame, proposal: DataFrame) -> DataFrame:
    """(amendment_id, ask_id, request, request_hash): the text a judge sees, as JSON.

    The ask with its context, the change, and the proposal's article that the change targets. Beyond the
    byte limit the article goes; a request still too long is null and not judged.
    """
    first = proposal.groupBy(F.lower("provision").alias("target")).agg(F.min_by("text", "article_id").alias("article"))
    rows = candidates.join(asks.select("ask_id", F.col("text").alias("ask"), F.col("context")), "ask_id").join(amendments, "amendment_id")
    rows = rows.withColumn("target", F.lower("target_provision")).join(first, "target", "left")
    parts = [F.substring("ask", 1, CONTEXT).alias("ask"), F.substring("context", 1, SHORT_CONTEXT).alias("context"), F.col("old_text").alias("old"), F.col("new_text").alias("new")]
    long, short = F.to_json(F.struct(*parts, F.col("article"))), F.to_json(F.struct(*parts))
    request = F.when(F.octet_length(long) <= MOST_BYTES, long).when(F.octet_length(short) <= MOST_BYTES, short)
    return rows.select("amendment_id", "ask_id", request.alias("request")).withColumn("request_hash", F.sha2("request", 256))


def support(answers: Column) -> Column:
    """The weakest of four answers: it asks, it supports, it does not oppose, it is not incidental."""
    return F.least(answers["asks"], answers["supports"], 1 - answers["opposes"], 1 - answers["incidental"])


def judged(request_rows: DataFrame, scores: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``answers`` from a table (request_hash, answers) or a function over the different requests."""
    known = request_rows.where("request is not null")
    table = scores(known.select("request_hash", "request").dropDuplicates(["request_hash"])) if callable(scores) else scores
    return known.join(table.select("request_hash", "answers"), "request_hash")


def reworded_origins(judged_rows: DataFrame, asks: DataFrame, verbatim: DataFrame, documents: DataFrame, amendments: DataFrame) -> DataFrame:
    """(document_id, amendment_id, ask_id, score, precedes, eligibility): the best supported ask per document and amendment.

    Pairs already found word for word are left out; so is what scores below the cutoff.
    """
    rows = judged_rows.withColumn("score", support(F.col("answers"))).where(F.col("score") >= CUTOFF)
    rows = rows.join(asks.select("ask_id", "document_id"), "ask_id").join(verbatim.select("document_id", "amendment_id"), ["document_id", "amendment_id"], "left_anti")
    best = Window.partitionBy("document_id", "amendment_id").orderBy(F.desc("score"), "ask_id")
    rows = rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    rows = rows.join(documents.select("document_id", "published_on"), "document_id").join(amendments.select("amendment_id", "tabled_on"), "amendment_id")
    before = precedes(F.col("published_on"), F.col("tabled_on"))
    return rows.select("document_id", "amendment_id", "ask_id", "score", before.alias("precedes"), eligibility(before).alias("eligibility"))
