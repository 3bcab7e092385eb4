"""New consultation documents as a stream: each is matched with known phrases as it arrives.

An extension beyond batch runs. The join is stateless: phrases are a static table, a document needs no
other one, so files may arrive in any order and a restarted stream goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.operators.matching import with_words
from warpline.operators.origins import phrase_runs


def read_documents(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """(document_id, text) of Parquet files as they appear."""
    return spark.readStream.schema("document_id string, text string").option("maxFilesPerTrigger", files).parquet(folder)


def write_origins(stream: DataFrame, phrases: DataFrame, common: DataFrame, target: str, checkpoint: str):
    """Starts a query that appends (document_id, phrase_id, first, end, words) of each batch to ``target``.

    A batch that is run again overwrites its own folder, so restarts leave no row twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = phrase_runs(phrases, with_words(batch), common).select("document_id", "phrase_id", "first", "end", "words")
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
