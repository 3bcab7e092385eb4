"""Uploaded documents: limits, error codes and text; PDF bytes need a parser that is not here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES, MOST_CHARACTERS = 8 << 20, 500_000
_BOM = "\ufeff"


def extract_text(files: DataFrame, content: str = "content", most_bytes: int = MOST_BYTES, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """Adds code (null if the document can be used), text and characters.

    Codes in the order in which they are found: document_too_large, empty_document (no bytes),
    invalid_utf8, text_too_large, empty_document (no text). A byte order mark is dropped.
    """
    size = F.octet_length(content)
    decoded = F.try_validate_utf8(F.col(content).cast("string"))
    text = F.when(F.startswith(decoded, F.lit(_BOM)), F.substring(decoded, 2, most_characters + 1)).otherwise(decoded)
    rows = files.withColumn("_text", F.when(size <= most_bytes, text))
    code = (
        F.when(size > most_bytes, "document_too_large").when(size == 0, "empty_document").when(F.col("_text").isNull(), "invalid_utf8")
        .when(F.length("_text") > most_characters, "text_too_large").when(F.trim("_text") == "", "empty_document")
    )
    rows = rows.withColumn("code", code)
    kept = F.when(F.col("code").isNull(), F.col("_text"))
    return rows.withColumns({"text": kept, "characters": F.length(kept)}).drop("_text")


def extraction_status(code, characters):
    """extracted, partial without text, or failed with its code."""
    return F.when(code.isNotNull(), "failed").when(characters > 0, "extracted").otherwise("empty")
