"""Stages: outputs under a key made of their inputs, a receipt written last, reuse only if all of it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warpline.functions import text as T


class StageStore:
    """Tables of a stage below ``root``/stage/key; the receipt is the last thing written, so a stage without one does not count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def key(self, *parts: str) -> str:
        return self.spark.range(1).select(T.input_hash(*[F.lit(p) for p in parts]).alias("k")).first()["k"]

    def path(self, stage: str, key: str, name: str) -> str:
        return f"{self.root}/{stage}/{key}/{name}"

    @staticmethod
    def fingerprint(df: DataFrame) -> DataFrame:
        """One row (records, digest): a digest that does not depend on the order of rows."""
        return df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))

    def save(self, stage: str, key: str, tables: dict[str, DataFrame], errors: list[str] | None = None) -> DataFrame:
        rows = []
        for name, df in tables.items():
            path = self.path(stage, key, name)
            df.write.mode("overwrite").parquet(path)
            seen = self.fingerprint(self.spark.read.parquet(path)).first()
            rows.append((stage, key, name, path, seen["records"], seen["digest"], "; ".join(errors or [])))
        receipt = self.spark.createDataFrame(rows, "stage string, key string, name string, path string, records long, digest string, errors string")
        receipt.coalesce(1).write.mode("overwrite").json(self.path(stage, key, "_receipt"))
        return receipt

    def load(self, stage: str, key: str) -> dict[str, DataFrame] | None:
        """The stage's tables if its receipt is there, without errors, and every table still has its digest; else None."""
        try:
            receipt = self.spark.read.json(self.path(stage, key, "_receipt")).collect()
        except Exception:  # no receipt: the stage has not ended
            return None
        tables = {}
        for row in receipt:
            if row["errors"]:
                return None
            try:
                df = self.spark.read.parquet(row["path"])
                seen = self.fingerprint(df).first()
            except Exception:  # a table is gone
                return None
            if (seen["records"], seen["digest"]) != (row["records"], row["digest"]):
                return None
            tables[row["name"]] = df
        return tables

    def publish(self, run: str, stages: list[tuple[str, str]]) -> DataFrame:
        """The manifest of verified stages; fails if one of them does not hold."""
        for stage, key in stages:
            if self.load(stage, key) is None:
                raise ValueError(f"stage {stage} is not complete")
        manifest = self.spark.createDataFrame([(run, s, k) for s, k in stages], "run string, stage string, key string")
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.root}/runs/{run}")
        return manifest

    def runs(self) -> DataFrame:
        """(run, stages), newest name first."""
        rows = self.spark.read.json(f"{self.root}/runs/*")
        return rows.groupBy("run").agg(F.count(F.lit(1)).alias("stages")).orderBy(F.desc("run"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line feed and nothing else, so other line separators may stand in strings; a bad line fails the read."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, value) of the lines that are no such record, numbered within their file from 1.

    A large file is read in blocks by several tasks; a line's number is its place in its block
    and the lines of the file's blocks before, which are counted first.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    blocks = lines.groupBy("file", "block").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    fields = [f.strip().split()[0] for f in schema.split(",")]
    parsed = lines.withColumn("r", F.from_json("value", schema))
    nothing = F.col("r").isNull()
    for name in fields:
        nothing = nothing | F.col(f"r.{name}").isNull()
    bad = parsed.where(nothing & (F.trim("value") != "")).join(blocks, ["file", "block"])
    return bad.select("file", (F.col("i") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def export(rows: DataFrame, path: str, order: list[str]) -> None:
    """The same rows as JSON lines, CSV and Markdown, each one ordered file, so reruns give the same bytes."""
    one = rows.coalesce(1).sortWithinPartitions(*order)
    one.write.mode("overwrite").json(f"{path}/jsonl")
    one.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    lines = [F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in rows.columns]
    one.select(F.concat_ws("\n", F.lit("##"), *lines, F.lit("")).alias("value")).write.mode("overwrite").text(f"{path}/markdown")


def write_view(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON document with an array per table."""
    whole = None
    for name, df in tables.items():
        part = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
        whole = part if whole is None else whole.crossJoin(part)
    whole.select(F.to_json(F.struct(*tables)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def union_stages(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of several stages' tables with the stage they come from; the same columns are asked for."""
    whole = None
    for stage, df in parts.items():
        own = df.withColumn("stage", F.lit(stage))
        whole = own if whole is None else whole.unionByName(own)
    return whole


def load_collected(store: StageStore, keys: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a collected law: documents of three stages, texts of two, and one law exactly."""
    stages = {}
    for name in ("texts", "amendments", "asks", "law"):
        tables = store.load(name, keys[name]) if name in keys else None
        if tables is None:
            raise ValueError(f"stage {name} is not complete")
        stages[name] = tables
    if stages["law"]["laws"].limit(2).count() != 1:
        raise ValueError("a collected run holds one law")
    documents = union_stages({s: stages[s]["documents"] for s in ("texts", "amendments", "asks")})
    texts = union_stages({s: stages[s]["document_texts"] for s in ("texts", "asks")})
    return {
        "law": stages["law"]["laws"], "actors": stages["law"]["actors"], "documents": documents, "document_texts": texts,
        "passages": stages["asks"]["passages"], "amendments": stages["amendments"]["amendments"], "articles": stages["texts"]["articles"],
    }


def tree_revision(spark: SparkSession, path: str) -> str:
    """One hash for a tree of files: of their names and contents in the order of names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    each = files.select(F.struct("path", F.sha2("content", 256).alias("h")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws("\0", x["path"], x["h"])), "\n")
    return each.agg(F.sha2(joined, 256).alias("h")).first()["h"]


def view_version(spark: SparkSession, path: str) -> DataFrame:
    """One row (files, bytes, changed): what tells whether a stored table is still the one that was read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length", "modificationTime")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("changed"))
