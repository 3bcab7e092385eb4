"""Consultations: the index of initiatives, submissions, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions import text as T
from warpline.operators.entities import CITIZENS
from warpline.sources.dump import text_or_null

ZONE = "Europe/Brussels"
PUBLICATION = "id bigint, type string, reference string, totalFeedback bigint"
FEEDBACK = "id bigint, userType string, trNumber string, referenceInitiative string, language string, feedback string, feedbackTextUserLanguage string, dateFeedback string, country string, companySize string, organization string, attachments array<struct<id:bigint,documentId:string,fileName:string>>"


def local_time(value: Column) -> Column:
    """yyyy/MM/dd HH:mm:ss of Brussels as an instant; null if it is none."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.trim(value), F.lit("yyyy/MM/dd HH:mm:ss")), ZONE)


def clean(text: Column) -> Column:
    """Without halves of surrogate pairs, which UTF-8 cannot hold."""
    return F.regexp_replace(text, r"[\x{D800}-\x{DFFF}]", "�")


def publications(raw: DataFrame) -> DataFrame:
    """Adds the COM references of each publication, all of them and the first."""
    return raw.withColumns({"reference": text_or_null(F.col("reference")), "com_references": T.com_references(F.col("reference")), "com_reference": T.com_reference(F.col("reference"))})


def index_entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, failures): the first sighting of each initiative over all pages; those without an id apart.

    ``pages`` has (page, place, initiative_id, title, publications).
    """
    first = F.row_number().over(Window.partitionBy("initiative_id").orderBy("page", "place"))
    good = pages.where("initiative_id is not null").withColumn("n", first).where("n = 1").drop("n")
    references = F.array_distinct(F.flatten(F.transform("publications", lambda p: T.com_references(p["reference"]))))
    return good.withColumn("com_references", references), pages.where("initiative_id is null").select("page", "place", F.lit("no_id").alias("reason"))


def carries(entry_references: Column, wanted: Column) -> Column:
    return F.array_contains(entry_references, wanted)


def find_initiatives(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(com, initiative_id): exact matches of ``wanted`` (com) on any reference, by an equi-join on the exploded references."""
    exploded = entries.select("initiative_id", F.explode("com_references").alias("com")).distinct()
    return exploded.join(wanted.select("com").distinct(), "com").select("com", "initiative_id")


def find_by_title(entries: DataFrame, words: str, com: str) -> DataFrame:
    """Entries whose title holds a word typed and that carry the reference, which decides."""
    typed = F.array(*[F.lit(w) for w in words.lower().split()])
    proposed = F.exists(typed, lambda w: F.contains(F.lower("title"), w))
    return entries.where(proposed & F.array_contains("com_references", com))


def initiatives(entries: DataFrame, com: str, title: str) -> DataFrame:
    """By reference, else by title; ``found_by`` says which."""
    exact = entries.where(F.array_contains("com_references", com)).withColumn("found_by", F.lit("reference"))
    fallback = find_by_title(entries, title, com).withColumn("found_by", F.lit("title"))
    have = exact.select(F.lit(True).alias("have")).limit(1)
    return exact.unionByName(fallback.join(have, F.lit(True), "left_anti"))


def for_this_law(references: Column, com: str) -> Column:
    """A publication without references may belong; one with others does not."""
    return (F.size(references) == 0) | F.array_contains(references, com)


def attachments(raw: Column) -> Column:
    """Those that have a document to download or cite."""
    return F.filter(raw, lambda a: text_or_null(a["documentId"]).isNotNull())


def submissions(raw: DataFrame) -> DataFrame:
    """One row per submission; citizens lose their organisation, and a register id counts only if the field holds one alone."""
    citizen = F.coalesce(F.col("userType").isin(*CITIZENS), F.lit(False))
    typed = F.when(~citizen, text_or_null(F.col("trNumber")))
    ids = F.regexp_extract_all(F.coalesce(typed, F.lit("")), F.lit(r"(\d{6,}-\d{2})"), F.lit(1))
    text, translation = clean(F.coalesce("feedback", F.lit(""))), text_or_null(F.col("feedbackTextUserLanguage"))
    return raw.select(
        F.col("id").alias("feedback_id"), text_or_null(F.col("referenceInitiative")).alias("reference"), T.com_reference(F.col("referenceInitiative")).alias("com_reference"),
        local_time(F.col("dateFeedback")).alias("submitted_at"), text.alias("text"), F.lower(text_or_null(F.col("language"))).alias("language"), F.col("userType").alias("user_type"),
        text_or_null(F.col("country")).alias("country"), F.when(~citizen, text_or_null(F.col("organization"))).alias("organisation"), F.when(F.size(ids) == 1, F.get(ids, F.lit(0))).alias("register_id"),
        F.when(translation != F.trim(text), clean(translation)).alias("english_translation"), attachments(F.col("attachments")).alias("attachments"),
    )


def feedback_documents(rows: DataFrame) -> DataFrame:
    """(document_id, source_kind, title, published_at, text): submissions and, without a text, their attachments."""
    direct = rows.select(T.document_id("hys_feedback", F.col("feedback_id").cast("string")).alias("document_id"), F.lit("hys_feedback").alias("source_kind"), F.col("organisation").alias("title"), F.col("submitted_at").alias("published_at"), "text")
    files = rows.select(F.explode("attachments").alias("a"), "submitted_at").select(T.document_id("hys_attachment", F.col("a.documentId")).alias("document_id"), F.lit("hys_attachment").alias("source_kind"), F.col("a.fileName").alias("title"), F.col("submitted_at").alias("published_at"), F.lit(None).cast("string").alias("text"))
    return direct.unionByName(files)


def read_pages(pages: DataFrame, last: DataFrame) -> DataFrame:
    """The rows of a publication's pages up to its last one; pages beyond it are not read."""
    return pages.join(last, "publication").where(F.col("page") <= F.col("last_page")).drop("last_page").select(*pages.columns)
