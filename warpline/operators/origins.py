"""Origins: which consultation documents said adopted or tabled wording, and whether they came first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions import text as T
from warpline.operators.matching import exploded_windows, longest_runs
from warpline.operators.meeting import meeting

CONSULTATION_KINDS = ("hys_feedback", "hys_attachment")


def consultation_only(documents: DataFrame) -> DataFrame:
    """Documents that somebody submitted; the law's own texts never match themselves."""
    return documents.where(F.col("source_kind").isin(*CONSULTATION_KINDS))


def eligibility(precedes: Column) -> Column:
    return F.when(precedes.isNull(), "unknown_date").when(precedes, "ask_first").otherwise("amendment_first")


def earliest(day: Column) -> Column:
    """As an aggregate: the first day, null if any is."""
    return F.when(F.count(F.lit(1)) == F.count(day), F.min(day))


def precedes(published: Column, first: Column) -> Column:
    """Strictly before; null if either is unknown."""
    return published < first


def with_tabling_days(adoptions: DataFrame, amendments: DataFrame) -> DataFrame:
    """An adoption without a day takes its amendment's."""
    own = amendments.select("amendment_id", F.col("tabled_on").alias("_day"))
    return adoptions.join(own, "amendment_id", "left").withColumn("tabled_on", F.coalesce("tabled_on", "_day")).drop("_day")


def submitters(passages: DataFrame, actors: DataFrame) -> DataFrame:
    """(document_id, actor_id, kind, name): the known actor of the first passage that has one."""
    known = passages.join(actors.select("actor_id", "kind", "name"), "actor_id")
    first = Window.partitionBy("document_id").orderBy("passage_order")
    return known.withColumn("n", F.row_number().over(first)).where("n = 1").select("document_id", "actor_id", "kind", "name")


def organisation(kind: Column, name: Column, source_kind: Column, title: Column) -> Column:
    """Citizens are never named; without a submitter the title names direct feedback alone."""
    return F.when(kind.isNotNull(), F.when(kind != "citizens", name)).when(source_kind == "hys_feedback", title)


def uncarried(phrases: DataFrame, carried: DataFrame) -> DataFrame:
    """Phrases that no amendment carries: must be empty."""
    return phrases.select("phrase_id").join(carried.select("phrase_id"), "phrase_id", "left_anti")


def phrase_runs(phrases: DataFrame, document_words: DataFrame, common: DataFrame) -> DataFrame:
    """(document_id, phrase_id, first, end, words, run_words): the longest significant run per pair."""
    own = phrases.withColumn("w", F.split("text", " "))
    within = meeting(document_words, own)
    inside = exploded_windows(own, "phrase_id", at="other_at", within=within)
    hits = exploded_windows(document_words, "document_id", within=within).join(inside.hint("merge"), "gram").select("document_id", "phrase_id", "at", "other_at")
    return longest_runs(hits, common, document_words, "document_id", "phrase_id")


def dated_origins(runs: DataFrame, owners: DataFrame, documents: DataFrame, amendments: DataFrame, *owner_keys: str) -> DataFrame:
    """Adds amendment_ids, earliest_on, precedes, eligibility and is_citation to runs, by the amendments of their ``owner_keys``."""
    dated = owners.join(amendments.select("amendment_id", "tabled_on").hint("merge"), "amendment_id")
    per = dated.groupBy(*owner_keys).agg(F.array_join(F.array_sort(F.collect_set("amendment_id")), ",").alias("amendment_ids"), earliest(F.col("tabled_on")).alias("earliest_on"))
    rows = runs.join(per.hint("merge"), list(owner_keys)).join(documents.select("document_id", "published_on", "organisation").hint("merge"), "document_id")
    first = precedes(F.col("published_on"), F.col("earliest_on"))
    return rows.withColumns({"precedes": first, "eligibility": eligibility(first), "is_citation": T.is_citation(F.col("run_words"))})


def adopted_origins(phrases: DataFrame, carried: DataFrame, document_words: DataFrame, documents: DataFrame, amendments: DataFrame, common: DataFrame) -> DataFrame:
    """Every (phrase, document) with its run, dates and standing."""
    return dated_origins(phrase_runs(phrases, document_words, common), carried, documents, amendments, "phrase_id")


def tabled_runs(amendment_words: DataFrame, proposal_words: DataFrame, document_words: DataFrame, common: DataFrame) -> DataFrame:
    """(document_id, amendment_id, first, end, words, run_words): the longest significant run per pair, adopted or not.

    Windows of an amendment count if they hold an inserted word and no proposal has them.
    """
    within = meeting(amendment_words, document_words)
    drafted = exploded_windows(proposal_words, "article_id", within=within).select("gram").distinct()
    own = exploded_windows(amendment_words, "amendment_id", at="other_at", mask_col="inserted", within=within).join(drafted.hint("merge"), "gram", "left_anti")
    hits = exploded_windows(document_words, "document_id", within=within).join(own.hint("merge"), "gram").select("document_id", "amendment_id", "at", "other_at")
    return longest_runs(hits, common, document_words, "document_id", "amendment_id")


def unadopted_runs(runs: DataFrame, phrases: DataFrame) -> DataFrame:
    """The rows of ``tabled_runs`` but those whose windows all lie in adopted phrases, with text and phrase_id."""
    adopted = exploded_windows(phrases.withColumn("w", F.split("text", " ")), "phrase_id").select("gram").distinct()
    keys = ["document_id", "amendment_id"]
    fresh = exploded_windows(runs, *keys, word_col="run_words").join(adopted.hint("merge"), "gram", "left_anti").select(*keys).distinct()
    return runs.join(fresh.hint("merge"), keys, "left_semi").withColumn("text", F.array_join("run_words", " ")).withColumn("phrase_id", T.digest(F.col("text")))


def tabled_origins(runs: DataFrame, documents: DataFrame, amendments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phrases, origins) of wording that amendments inserted and documents also say, from ``unadopted_runs``.

    Equal runs are one phrase, dated for a document by the amendments that share the run with that document.
    """
    found = runs.groupBy("phrase_id").agg(F.first("text").alias("text"), F.first("words").alias("words"), F.array_join(F.array_sort(F.collect_set("amendment_id")), ",").alias("amendment_ids"))
    owners = runs.select("document_id", "phrase_id", "amendment_id").distinct()
    one = Window.partitionBy("document_id", "phrase_id").orderBy("amendment_id")
    single = runs.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n", "amendment_id", "text")
    return found, dated_origins(single, owners, documents, amendments, "document_id", "phrase_id")


def counts_as_origin(origin_rows: DataFrame) -> DataFrame:
    """Asked first, and no citation."""
    return origin_rows.where((F.col("eligibility") == "ask_first") & ~F.col("is_citation"))


def ordered(origin_rows: DataFrame) -> DataFrame:
    """Longest first, then document and phrase."""
    return origin_rows.orderBy(F.desc("words"), "document_id", "phrase_id")


def dangling(phrases: DataFrame, tabled: DataFrame, origin_rows: DataFrame, carried: DataFrame, amendments: DataFrame) -> DataFrame:
    """(problem, key): references that lead nowhere, and phrases both adopted and tabled. Must be empty."""
    known = phrases.select("phrase_id").unionByName(tabled.select("phrase_id"))
    problem = lambda df, name, key: df.select(F.lit(name).alias("problem"), F.col(key).alias("key"))
    return (
        problem(origin_rows.join(known.hint("merge"), "phrase_id", "left_anti"), "origin without phrase", "phrase_id")
        .unionByName(problem(carried.join(known.hint("merge"), "phrase_id", "left_anti"), "carrier without phrase", "phrase_id"))
        .unionByName(problem(carried.join(amendments.select("amendment_id").hint("merge"), "amendment_id", "left_anti"), "carrier without amendment", "amendment_id"))
        .unionByName(problem(phrases.join(tabled.select("phrase_id").hint("merge"), "phrase_id", "left_semi"), "adopted and tabled", "phrase_id"))
        .distinct()
    )
