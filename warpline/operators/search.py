"""Ranking: BM25 over passages, title search, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions import text as T
from warpline.functions.udfs import changed_spans, passage_spans, read_changes

K1, B, TOP, UNIT = 1.2, 0.75, 5, float(1 << 40)
MOST_CHARACTERS, MOST_TOKENS = 12_000, 800
ENOUGH, CLOSE, CHOICES = 0.5, 0.97, 3


def term_statistics(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((passage_id, term, n, length), (term, df, idf)) of (passage_id, w) rows; passages without words count too."""
    counts = passages.select("passage_id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("passage_id", "length", "term").agg(F.count(F.lit(1)).alias("n"))
    total = passages.agg(F.count(F.lit(1)).alias("total"), F.avg(F.size("w")).alias("average"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(total)
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counts, df.select("term", "df", idf.alias("idf"), "average")


def bm25(passages: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, passage_id, score, rank): the ``k`` best passages of each query.

    ``passages`` has (passage_id, place, w), ``queries`` (query_id, terms). Each different term counts once; a
    passage that shares none is no result; ties go to the earlier place. Weights belong to the postings
    and are made once; a query adds up those of its terms, in the order of the terms.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    # Only the postings of words that are asked for are made; their statistics are those of all passages.
    words = passages.select("passage_id", "place", F.size("w").alias("length"), F.explode("w").alias("term"))
    counts = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("passage_id", "place", "length", "term").agg(F.count(F.lit(1)).alias("n"))
    total = passages.agg(F.count(F.lit(1)).alias("total"), F.avg(F.size("w")).alias("average"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(total)
    terms = df.select("term", F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "average")
    saturation = F.col("n") + K1 * (1 - B + B * F.col("length") / F.col("average"))
    # Weights in units of 2**-40: sums of whole numbers do not depend on the order of the terms, so ranks and ties
    # are the same in every run.
    weight = F.round(F.col("idf") * F.col("n") * (K1 + 1) / saturation * UNIT).cast("long")
    # Merged, so that the postings keep their partitions however small the table of terms is.
    postings = counts.join(terms.hint("merge"), "term").select("passage_id", "place", "term", weight.alias("weight"))
    scored = asked.join(postings, "term").groupBy("query_id", "passage_id", "place").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "place")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "passage_id", (F.col("weight") / UNIT).alias("score"), "rank")


def with_context(passages: DataFrame) -> DataFrame:
    """Adds context_start and context_end: from the passage before to the one after, within the document."""
    order = Window.partitionBy("document_id").orderBy("start")
    return passages.withColumns({"context_start": F.coalesce(F.lag("start").over(order), "start"), "context_end": F.coalesce(F.lead("end").over(order), "end")})


def passage_rows(documents: DataFrame) -> DataFrame:
    """(passage_id, document_id, number, start, end, text): overlapping windows of sentences, numbered from 1."""
    cut = documents.select("document_id", "text", F.posexplode(passage_spans("text")).alias("at", "p"))
    number = F.col("at") + 1
    text = F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    name = F.concat(F.lit("passage:"), T.id_part(F.col("document_id")), F.lit(":"), number.cast("string"))
    return cut.select(name.alias("passage_id"), "document_id", number.alias("number"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), text.alias("text"))


def valid_change(old: Column, new: Column) -> Column:
    """Not both blank, and neither side too long for the diff; an unknown old side counts as empty."""
    old = F.coalesce(old, F.lit(""))
    bounded = lambda x: (F.length(x) <= MOST_CHARACTERS) & (F.size(T.tokens(x)) <= MOST_TOKENS)
    return ((F.trim(old) != "") | (F.trim(new) != "")) & bounded(old) & bounded(new)


def change_terms(amendments: DataFrame) -> DataFrame:
    """(amendment_id, query_kind, valid, terms): sorted different words of the change, of the whole new text if the old one is unknown."""
    valid = valid_change(F.col("old_text"), F.col("new_text"))
    rows = amendments.select("amendment_id", "new_text", "old_text", valid.alias("valid"))
    rows = rows.withColumn("spans", changed_spans(F.when(F.col("valid"), F.col("old_text")), F.col("new_text")))
    changed = F.array_join(F.transform("spans", lambda s: s["text"]), " ")
    text = F.when(F.col("old_text").isNull(), F.col("new_text")).otherwise(changed)
    terms = F.array_sort(F.array_distinct(T.words(F.coalesce(text, F.lit("")))))
    return rows.select("amendment_id", F.when(F.col("old_text").isNull(), "whole_text").otherwise("delta").alias("query_kind"), "valid", terms.alias("terms"))


def candidates(amendments: DataFrame, asks: DataFrame, k: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(candidates, unsearchable): the best asks for each amendment's changed words.

    ``asks`` has (ask_id, place, text). Asks beyond the diff's bounds are taken out before the index is
    built; amendments beyond them, or without a word to search, come back as unsearchable.
    """
    bounded = asks.where(valid_change(F.lit(None).cast("string"), F.col("text"))).select(F.col("ask_id").alias("passage_id"), "place", T.words(F.col("text")).alias("w"))
    terms = change_terms(amendments)
    searchable = F.col("valid") & (F.size("terms") > 0)
    found = bm25(bounded, terms.where(searchable).select(F.col("amendment_id").alias("query_id"), "terms"), k)
    name = F.concat(F.lit("cand:"), T.id_part(F.col("query_id")), F.lit(":"), T.id_part(F.col("passage_id")))
    rows = found.select(name.alias("candidate_id"), F.col("query_id").alias("amendment_id"), F.col("passage_id").alias("ask_id"), F.col("rank").alias("lexical_rank"), "score")
    return rows, terms.where(~searchable).select("amendment_id")


def title_scores(titles: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, title_id, score, rank, ambiguous): the best titles that hold at least half of a query's words.

    Nine tenths are the share of the query's words, one tenth that of the title's. Candidates meet by a
    shared word, not by crossing all titles with all queries.
    """
    q = queries.select("query_id", T.title_words(F.col("query")).alias("qw"))
    t = titles.select("title_id", T.title_words(F.col("title")).alias("tw"))
    shared = (
        q.select("query_id", F.size("qw").alias("qn"), F.explode("qw").alias("word"))
        .join(t.select("title_id", F.size("tw").alias("tn"), F.explode("tw").alias("word")), "word")
        .groupBy("query_id", "title_id", "qn", "tn").agg(F.count(F.lit(1)).alias("n"))
    )
    scored = shared.withColumn("score", F.col("n") / F.col("qn") * 0.9 + F.col("n") / F.col("tn") * 0.1).where(F.col("score") >= ENOUGH)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "title_id")
    ranked = scored.withColumns({"rank": F.row_number().over(order), "best": F.first("score").over(order), "second": F.nth_value("score", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    close = F.coalesce(F.col("second") >= F.col("best") * CLOSE, F.lit(False))
    return ranked.where(F.col("rank") <= CHOICES).select("query_id", "title_id", "score", "rank", close.alias("ambiguous"))


def by_alias(queries: DataFrame, aliases: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, status, title_ids): what an equal name stands for.

    ``key`` in all three is a caseless name. One title is chosen, several are choices, and an alias of an unknown
    title is missing; queries that no alias equals are left to the title search.
    """
    named = queries.join(aliases.select("key", "title_id"), "key").select("query_id", "title_id")
    titled = queries.join(titles.select("key", "title_id"), "key").select("query_id", "title_id")
    every = named.unionByName(titled.join(named.select("query_id").distinct(), "query_id", "left_semi")).distinct()
    known = titles.select("title_id").distinct().withColumn("known", F.lit(True))
    per = every.join(known, "title_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_set("title_id")).alias("ids"), F.max(F.coalesce("known", F.lit(False))).alias("known"))
    status = F.when(F.size("ids") > 1, "ambiguous").when(F.col("known"), "chosen").otherwise("missing")
    return per.select("query_id", status.alias("status"), F.array_join("ids", ",").alias("title_ids"))


# --- Asks ---------------------------------------------------------------------------------


def with_direction(rows: DataFrame) -> DataFrame:
    """Adds ``changes`` (what a text asks for) and ``direction``, read from quoted instructions alone.

    Prose states no change, so its direction is unknown, and so is that of a text with an instruction
    beyond the diff's bounds.
    """
    rows = rows.withColumn("changes", read_changes("text")).withColumn("_row", F.monotonically_increasing_id())
    told = rows.select("_row", F.explode("changes").alias("c")).where("c.kind <> 'statement'").select("_row", F.col("c.old").alias("old"), F.col("c.new").alias("new"), valid_change(F.col("c.old"), F.col("c.new")).alias("valid"))
    spans = changed_spans(F.when(F.col("valid"), F.col("old")), F.col("new"))
    words = F.flatten(F.transform(spans, lambda s: F.transform(F.split(s["text"], r"\s+"), lambda w: F.struct(s["operation"].alias("operation"), w.alias("word")))))
    told = told.withColumn("words", F.coalesce(words, F.expr("cast(array() as array<struct<operation:string,word:string>>)")))
    per = told.groupBy("_row").agg(F.flatten(F.collect_list("words")).alias("words"), F.min("valid").alias("valid"))
    joined = rows.join(per, "_row", "left")
    return joined.withColumn("direction", F.when(F.coalesce("valid", F.lit(False)), T.direction(F.col("words"))).otherwise("unknown")).drop("_row", "words", "valid")


def limit_reason(changes: Column) -> Column:
    """Why an ask is not searched: nothing to read, or a reading beyond the diff's bounds; null if it is."""
    good = F.forall(changes, lambda c: valid_change(c["old"], c["new"]))
    return F.when(F.size(changes) == 0, "no statement and no quoted instruction").when(~good, "beyond the bounds of the diff")


def asks(passages: DataFrame) -> DataFrame:
    """(ask_id, passage_id, document_id, start, end, text, direction, limit_reason): one ask per passage, quoted whole."""
    rows = with_direction(passages)
    name = F.concat(F.lit("ask:"), T.id_part(F.col("passage_id")))
    return rows.select(name.alias("ask_id"), "passage_id", "document_id", "start", "end", "text", "direction", limit_reason(F.col("changes")).alias("limit_reason"))


def resolve_law(queries: DataFrame, entries: DataFrame, aliases: DataFrame, key) -> DataFrame:
    """(query_id, kind, status, found): what was typed, as one procedure, several to choose from, or none.

    Procedure, CELEX and COM references are equi-joins on the catalog; other text is a common name of
    ``aliases`` (key, title_id), else a title. ``key`` makes a caseless name of a column.
    """
    q = queries.select("query_id", T.query_kind(F.col("query")).alias("q")).select("query_id", "q.kind", "q.value")
    own = entries.select(F.lit("procedure").alias("kind"), F.col("procedure_id").alias("value"), "procedure_id")
    celex = entries.where("celex_final is not null").select(F.lit("celex").alias("kind"), F.col("celex_final").alias("value"), "procedure_id")
    com = entries.select(F.lit("com").alias("kind"), F.explode("com_references").alias("value"), "procedure_id")
    known = own.unionByName(celex).unionByName(com).distinct()
    exact = q.join(known, ["kind", "value"]).groupBy("query_id").agg(F.array_sort(F.collect_set("procedure_id")).alias("ids"))
    typed = q.where("kind = 'title'").select("query_id", key(F.col("value")).alias("key"), F.col("value").alias("query"))
    titles = entries.select(F.col("procedure_id").alias("title_id"), "title", key(F.col("title")).alias("key"))
    named = by_alias(typed, aliases, titles).select("query_id", "status", F.col("title_ids").alias("found"))
    scored = title_scores(titles, typed.join(named, "query_id", "left_anti").select("query_id", "query"))
    best = scored.groupBy("query_id").agg(F.max("ambiguous").alias("several"), F.array_sort(F.collect_list(F.struct("rank", "title_id"))).alias("r"))
    ids = F.transform("r", lambda x: x["title_id"])
    titled = best.select("query_id", F.when(F.col("several"), "ambiguous").otherwise("chosen").alias("status"), F.when(F.col("several"), F.array_join(ids, ",")).otherwise(F.get(ids, F.lit(0))).alias("found"))
    exact = exact.select("query_id", F.when(F.size("ids") > 1, "ambiguous").otherwise("chosen").alias("status"), F.array_join("ids", ",").alias("found"))
    every = exact.unionByName(named).unionByName(titled)
    return q.join(every, "query_id", "left").select("query_id", "kind", F.coalesce("status", F.lit("unknown")).alias("status"), "found")
