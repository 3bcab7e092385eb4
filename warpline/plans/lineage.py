"""The flagship plan: from articles, amendments and documents to phrases, carriers, credits and origins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.operators import adoption as A
from warpline.operators import insights as I
from warpline.operators import origins as O
from warpline.operators.matching import common_words, with_words
from warpline.plans import world
from warpline.session import Scratch


@dataclass
class Lineage:
    """The tables of one law's lineage. Nothing runs until one of them is used; each is a plan of its own.

    With ``keep`` the small tables that several others are made of (runs, phrases, carriers, origins) are written to the
    shared folder when first asked for, and read from there. So no plan holds another, and what the driver and the disks held for a table goes with its plan.
    ``close`` forgets them; their files stay until the folder is cleaned, as results may still read them.
    """

    articles: DataFrame
    amendments: DataFrame
    documents: DataFrame
    keep: bool = False

    @classmethod
    def of_tables(cls, spark: SparkSession, sf_dir: str, keep: bool = False) -> Lineage:
        """Over the stand-in records of the test tables."""
        return cls(world.articles(spark, sf_dir), world.amendments(spark, sf_dir), world.consultations(spark, sf_dir), keep)

    @cached_property
    def _scratch(self) -> Scratch:
        return Scratch(self.documents.sparkSession, "lineage")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """The table as it was written. The driver collects its garbage then: plans, broadcasts and shuffle files live until it does."""
        if not self.keep:
            return df
        saved = self._scratch.save(df, name)
        del df
        self._scratch.spark._jvm.System.gc()
        return saved

    def close(self) -> None:
        for name in ("runs", "phrases", "carried", "origins", "tabled_runs", "tabled", "all_origins", "common", "units", "_scratch"):
            if self.keep:
                self.__dict__.pop(name, None)

    @cached_property
    def article_words(self) -> DataFrame:
        return with_words(self.articles)

    @cached_property
    def amendment_words(self) -> DataFrame:
        return A.with_inserted(self.amendments)

    @cached_property
    def document_words(self) -> DataFrame:
        return with_words(self.documents)

    @cached_property
    def common(self) -> DataFrame:
        return self._kept(common_words(self.article_words), "common")

    @cached_property
    def runs(self) -> DataFrame:
        return self._kept(A.adopted_runs(self.amendment_words, self.article_words, self.common), "runs")

    @cached_property
    def phrases(self) -> DataFrame:
        return self._kept(A.adopted_phrases(self.runs, self.article_words), "phrases")

    @cached_property
    def carried(self) -> DataFrame:
        return self._kept(A.carriers(self.runs, self.phrases), "carried")

    @cached_property
    def adoptions(self) -> DataFrame:
        """Adopting amendments with their authors as arrays."""
        own = self.authored.join(self.carried.select("amendment_id").distinct(), "amendment_id", "left_semi")
        return own.select("amendment_id", "stage", "committee", "tabled_on", "author_ids", "author_names", "author_groups")

    @cached_property
    def authored(self) -> DataFrame:
        none = F.expr("cast(array() as array<string>)")
        if "author_ids" in self.amendments.columns:
            return self.amendments
        return self.amendments.withColumns({"author_ids": F.array("author_id"), "author_names": none, "author_groups": F.array("author_group")})

    @cached_property
    def tablers(self) -> DataFrame:
        return A.holders(self.authored)

    @cached_property
    def wording(self) -> DataFrame:
        """Digests: which wordings are the same is all that is asked."""
        return self.amendment_words.select("amendment_id", F.sha2(F.array_join("w", " "), 256).alias("wording"))

    @cached_property
    def credits(self) -> DataFrame:
        return A.credits(self.carried, self.tablers, self.wording)

    @cached_property
    def origins(self) -> DataFrame:
        """Word-for-word origins; ``kind`` and ``actor_id`` are there for the summaries."""
        found = O.adopted_origins(self.phrases, self.carried, self.document_words, self.documents, self.amendments, self.common)
        return self._kept(found.withColumns({"kind": F.lit("verbatim"), "actor_id": F.lit(None).cast("string")}), "origins")

    @cached_property
    def tabled_runs(self) -> DataFrame:
        drafted = self.article_words.where("stage = 'proposal'")
        every = self._kept(O.tabled_runs(self.amendment_words, drafted, self.document_words, self.common), "every_run")
        runs = self._kept(O.unadopted_runs(every, self.phrases), "tabled_runs")
        if self.keep:
            self._scratch.drop("every_run")
        return runs

    @cached_property
    def tabled(self) -> tuple[DataFrame, DataFrame]:
        return O.tabled_origins(self.tabled_runs, self.documents, self.amendments)

    @cached_property
    def all_origins(self) -> DataFrame:
        more = self.tabled[1].withColumns({"kind": F.lit("verbatim"), "actor_id": F.lit(None).cast("string")})
        return self._kept(self.origins.unionByName(more.select(*self.origins.columns)), "all_origins")

    @cached_property
    def ranking(self) -> DataFrame:
        return I.rank_organisations(self.all_origins, self.phrases)

    @cached_property
    def units(self) -> DataFrame:
        return self._kept(A.unit_counts(self.runs, self.article_words), "units")

    def counts(self) -> DataFrame:
        """One row: amendments, adopting ones, phrases, without a group, documents read, with an origin that counts, changed and linked words."""
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        one = n(self.amendments, "amendments").crossJoin(self.carried.agg(F.countDistinct("amendment_id").alias("amendments_adopting"), F.countDistinct("phrase_id").alias("adopted_phrases")))
        one = one.crossJoin(A.phrases_without_group(self.carried, self.tablers)).crossJoin(n(self.documents, "documents_read"))
        first = O.counts_as_origin(self.all_origins).agg(F.countDistinct("document_id").alias("documents_with_origin"))
        return one.crossJoin(first).crossJoin(self.units)
