"""Adopted wording: which new words of the final act stand in which amendments, and whose credit that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.functions import text as T
from warpline.functions.udfs import inserted_mask, word_offsets
from warpline.operators.matching import common_words, exploded_windows, fold_runs, novel_places, novel_windows, place_intervals, significant, with_words
from warpline.operators.meeting import meeting

LONGEST_DIFF, COMMITTEE_TEXT = 3000, "committee_text"


def with_inserted(amendments: DataFrame) -> DataFrame:
    """Adds w (folded words of the new text), inserted (array<boolean>) and basis.

    Without an old text all is inserted; beyond ``LONGEST_DIFF`` words on a side the words that the old text
    lacks are; else a word diff says which. Only the last reaches Python.
    """
    rows = with_words(amendments, "new_text").withColumn("_old", T.words("old_text"))
    basis = F.when(F.col("old_text").isNull(), "unknown_original").when((F.size("_old") > LONGEST_DIFF) | (F.size("w") > LONGEST_DIFF), "approximate").otherwise("exact")
    rows = rows.withColumn("basis", basis)
    exact = inserted_mask(F.when(F.col("basis") == "exact", F.col("_old")), F.when(F.col("basis") == "exact", F.col("w")))
    mask = (
        F.when(F.col("basis") == "unknown_original", F.transform("w", lambda x: F.lit(True)))
        .when(F.col("basis") == "approximate", F.transform("w", lambda x: ~F.array_contains("_old", x)))
        .otherwise(exact)
    )
    return rows.withColumn("inserted", mask).drop("_old")


def _all_inserted(amendments: DataFrame) -> DataFrame:
    return with_words(amendments, "new_text").withColumns({"inserted": F.transform("w", lambda x: F.lit(True)), "basis": F.lit("unknown_original")})


def adopted_runs(amendment_words: DataFrame, article_words: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """(amendment_id, start, end, article_id, position): kept runs, a row per place in the final act.

    A run must hold an inserted word first, then enough of the law's rare words: of those not in ``common``, by default the provisions' common words.
    """
    within = meeting(amendment_words, article_words.where("stage = 'final_act'"))
    windows = exploded_windows(amendment_words, "amendment_id", within=within)
    final = novel_windows(article_words, within).withColumnRenamed("at", "other_at")
    hits = windows.join(final.hint("merge"), "gram").select("amendment_id", "at", "article_id", "other_at")
    runs = fold_runs(hits, "amendment_id").withColumn("end", F.col("last") + T.WINDOW)
    runs = runs.join(amendment_words.select("amendment_id", "w", "inserted").hint("merge"), "amendment_id")
    part = lambda name: F.slice(name, F.col("start") + 1, F.col("end") - F.col("start"))
    runs = runs.where(F.exists(part("inserted"), lambda x: x)).withColumn("run_words", part("w"))
    kept = significant(runs.select("amendment_id", "start", "end", "diagonals", "run_words"), common_words(article_words) if common is None else common)
    return kept.select("amendment_id", "start", "end", F.explode("diagonals").alias("d")).select("amendment_id", "start", "end", "d.article_id", (F.col("start") + F.col("d.shift")).alias("position"))


def covered_places(runs: DataFrame) -> DataFrame:
    """(amendment_id, article_id, position): each word of the final act that a run of the amendment covers."""
    return runs.select("amendment_id", "article_id", F.explode(F.sequence("position", F.col("position") + F.col("end") - F.col("start") - 1)).alias("position")).distinct()


def adopted_phrases(runs: DataFrame, article_words: DataFrame) -> DataFrame:
    """(phrase_id, article_id, first, end, words, text): merged places, known by where they stand."""
    spans = place_intervals(covered_places(runs).select("article_id", "position")).join(article_words.select("article_id", "w").hint("merge"), "article_id")
    return spans.select(
        T.place_digest(F.col("article_id"), F.col("first"), F.col("end")).alias("phrase_id"), "article_id", "first", "end",
        (F.col("end") - F.col("first")).alias("words"), F.array_join(F.slice("w", F.col("first") + 1, F.col("end") - F.col("first")), " ").alias("text"),
    )


def quoted_phrases(phrases: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds span_start, span_end and quote: the exact wording in the provision's own text."""
    placed = phrases.join(articles.select("article_id", F.col("text").alias("_text")), "article_id").withColumn("_o", word_offsets("_text"))
    start, end = F.get("_o", F.col("first"))["start"], F.get("_o", F.col("end") - 1)["end"]
    return placed.withColumns({"span_start": start, "span_end": end, "quote": F.substring("_text", start + 1, end - start)}).drop("_text", "_o")


def carriers(runs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase_id, amendment_id): whose runs cover a word of the phrase."""
    where = phrases.select("phrase_id", "article_id", F.explode(F.sequence("first", F.col("end") - 1)).alias("position"))
    return covered_places(runs).join(where.hint("merge"), ["article_id", "position"]).select("phrase_id", "amendment_id").distinct()


def amendment_adoptions(runs: DataFrame, carried: DataFrame, amendment_words: DataFrame) -> DataFrame:
    """One row per adopting amendment: phrase_ids (sorted), adopted_words, inserted_words, new_words, longest_run.

    Runs overlap where they switch places, so adopted words are counted by position.
    """
    spans = runs.select("amendment_id", "start", "end").distinct()
    positions = spans.select("amendment_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("p")).distinct()
    adopted = positions.groupBy("amendment_id").agg(F.count(F.lit(1)).alias("adopted_words"))
    longest = spans.groupBy("amendment_id").agg(F.max(F.col("end") - F.col("start")).alias("longest_run"))
    phrases = carried.groupBy("amendment_id").agg(F.array_join(F.array_sort(F.collect_set("phrase_id")), ",").alias("phrase_ids"))
    own = amendment_words.select("amendment_id", F.size(F.filter("inserted", lambda x: x)).alias("inserted_words"), F.size("w").alias("new_words"))
    return phrases.join(adopted, "amendment_id").join(longest, "amendment_id").join(own, "amendment_id")


def unit_counts(runs: DataFrame, article_words: DataFrame) -> DataFrame:
    """One row: changed_units (words in novel windows of the final act) and linked_units (words in kept runs)."""
    novel = novel_places(article_words).select("article_id", F.explode(F.sequence("at", F.col("at") + T.WINDOW - 1)).alias("position")).distinct()
    linked = covered_places(runs).select("article_id", "position").distinct()
    return novel.agg(F.count(F.lit(1)).alias("changed_units")).crossJoin(linked.agg(F.count(F.lit(1)).alias("linked_units")))


def adoption_status(articles: DataFrame) -> DataFrame:
    """One row (status, reason): unknown without a final act, then without a proposal."""
    have = articles.agg(F.max(F.col("stage") == "final_act").alias("final"), F.max(F.col("stage") == "proposal").alias("draft"))
    reason = F.when(~F.coalesce("final", F.lit(False)), "no text of the final act: nothing can be traced").when(
        ~F.coalesce("draft", F.lit(False)), "no text of the proposal: new wording cannot be told from it"
    )
    return have.select(F.when(reason.isNull(), "computed").otherwise("unknown").alias("status"), reason.alias("reason"))


# --- Credit -------------------------------------------------------------------------------


def _named_group(name: Column) -> Column:
    found = F.regexp_extract(name, r"(?i)\bon behalf of the (.+?) group\b", 1)
    return F.when(found != "", F.trim(found))


def holders(amendments: DataFrame) -> DataFrame:
    """(amendment_id, holder, kind, name, group): the tablers, from the most to the least precise record.

    ``amendments`` has author_ids, author_names and author_groups (arrays, groups aligned with ids, a null
    group unknown). Members come first; else names, of which one may name a group; else the committee's text.
    """
    member = F.transform(
        F.arrays_zip(F.col("author_ids").alias("i"), F.col("author_groups").alias("g")),
        lambda x: F.struct(x["i"].alias("holder"), F.lit("mep").alias("kind"), x["i"].alias("name"), x["g"].alias("grp")),
    )
    named = F.transform(
        "author_names",
        lambda n: F.struct(
            F.when(_named_group(n).isNotNull(), F.concat(F.lit("group:"), _named_group(n))).otherwise(F.concat(F.lit("name:"), n)).alias("holder"),
            F.when(_named_group(n).isNotNull(), "group").otherwise("unresolved").alias("kind"),
            F.coalesce(_named_group(n), n).alias("name"),
            F.lit(None).cast("string").alias("grp"),
        ),
    )
    text = F.array(F.struct(F.lit(COMMITTEE_TEXT).alias("holder"), F.lit(COMMITTEE_TEXT).alias("kind"), F.lit("Committee text").alias("name"), F.lit(None).cast("string").alias("grp")))
    chosen = F.when(F.size("author_ids") > 0, member).when(F.size("author_names") > 0, named).otherwise(text)
    return amendments.select("amendment_id", F.explode(chosen).alias("h")).select("amendment_id", "h.holder", "h.kind", "h.name", F.col("h.grp").alias("group"))


def _keys(tablers: DataFrame) -> DataFrame:
    """(amendment_id, holder, kind, name): tablers and, for members with a known group, the group."""
    groups = tablers.where("kind = 'mep' and `group` is not null").select("amendment_id", F.concat(F.lit("group:"), "group").alias("holder"), F.lit("group").alias("kind"), F.col("group").alias("name"))
    return tablers.select("amendment_id", "holder", "kind", "name").unionByName(groups).distinct()


def credits(carried: DataFrame, tablers: DataFrame, texts: DataFrame) -> DataFrame:
    """(holder_id, holder_kind, name, phrases, joint_phrases, amendments, amendments_tabled).

    Every holder of a phrase is credited with all of it; it is joint if another tabler, or for a group another group,
    holds it too. Committee text counts only where nobody is named. Amendments count by different
    new wording: ``texts`` has (amendment_id, wording), a digest of the wording will do.
    """
    keys = _keys(tablers)
    held = carried.join(keys, "amendment_id").withColumn("is_group", F.col("kind") == "group")
    named = held.where(F.col("holder") != COMMITTEE_TEXT).join(tablers.select("amendment_id", "holder").distinct(), ["amendment_id", "holder"], "left_semi")
    has_named = named.select("phrase_id").distinct().withColumn("named", F.lit(True))
    held = held.join(has_named, "phrase_id", "left").where((F.col("holder") != COMMITTEE_TEXT) | F.col("named").isNull())
    tabler_key = tablers.select("amendment_id", "holder").distinct().withColumn("tables", F.lit(True))
    held = held.join(tabler_key, ["amendment_id", "holder"], "left").withColumn("tables", F.coalesce("tables", F.lit(False)))
    per = held.groupBy("phrase_id", "holder", "kind", "name", "is_group").agg(F.max("tables").alias("tables"))
    sizes = per.groupBy("phrase_id").agg(F.count(F.when(F.col("is_group"), 1)).alias("groups"), F.count(F.when(F.col("tables"), 1)).alias("tablers"))
    joint = F.when(F.when(F.col("is_group"), F.col("groups")).otherwise(F.col("tablers")) > 1, 1).otherwise(0)
    counted = per.join(sizes, "phrase_id").groupBy("holder", "kind", "name").agg(F.count(F.lit(1)).alias("phrases"), F.sum(joint).alias("joint_phrases"))
    adopting = held.join(texts, "amendment_id").groupBy("holder").agg(F.countDistinct("wording").alias("amendments"))
    tabled = keys.join(texts, "amendment_id").groupBy("holder").agg(F.countDistinct("wording").alias("amendments_tabled"))
    joined = counted.join(adopting, "holder").join(tabled, "holder")
    return joined.select(
        F.regexp_replace("holder", "^group:", "").alias("holder_id"), F.col("kind").alias("holder_kind"), "name", "phrases", "joint_phrases", "amendments", "amendments_tabled"
    )


def ranked_credits(credit_rows: DataFrame) -> DataFrame:
    """By kind, adopted share of what was tabled, tabled, phrases, id; ``place`` counts within the kind."""
    from pyspark.sql import Window

    rate = F.try_divide(F.col("amendments"), F.col("amendments_tabled"))
    order = Window.partitionBy("holder_kind").orderBy(F.desc("rate"), F.desc("amendments_tabled"), F.desc("phrases"), "holder_id")
    return credit_rows.withColumn("rate", rate).withColumn("place", F.row_number().over(order))


def phrases_without_group(carried: DataFrame, tablers: DataFrame) -> DataFrame:
    """One row: how many carried phrases have no holder with a known group."""
    grouped = carried.join(_keys(tablers).where("kind = 'group'"), "amendment_id").select("phrase_id").distinct()
    return carried.select("phrase_id").distinct().join(grouped, "phrase_id", "left_anti").agg(F.count(F.lit(1)).alias("phrases_without_group"))


def coalition_phrases(carried: DataFrame, tablers: DataFrame, least: int = 2) -> DataFrame:
    """(phrase_id, groups) of phrases carried by ``least`` or more different known groups."""
    groups = carried.join(tablers.where("`group` is not null"), "amendment_id").groupBy("phrase_id").agg(F.countDistinct("group").alias("groups"))
    return groups.where(F.col("groups") >= least)


def recorded_groups(amendments: DataFrame, latest: DataFrame) -> DataFrame:
    """(amendment_id, author_id, group): the groups an amendment records, a recorded null included; without any, the latest ones."""
    recorded = amendments.where(F.size("author_groups") > 0).select("amendment_id", F.explode(F.arrays_zip(F.col("author_ids").alias("i"), F.col("author_groups").alias("g"))).alias("x"))
    recorded = recorded.select("amendment_id", F.col("x.i").alias("author_id"), F.col("x.g").alias("group"))
    other = amendments.where(F.coalesce(F.size("author_groups"), F.lit(0)) <= 0).select("amendment_id", F.explode("author_ids").alias("author_id"))
    return recorded.unionByName(other.join(latest.select("author_id", "group"), "author_id", "left").select("amendment_id", "author_id", "group"))


def uses_latest_groups(amendments: DataFrame) -> DataFrame:
    """One row: whether an authored amendment records no groups, so that the latest ones stand in."""
    bare = (F.size("author_ids") > 0) & (F.coalesce(F.size("author_groups"), F.lit(0)) <= 0)
    return amendments.agg(F.coalesce(F.max(bare), F.lit(False)).alias("uses_latest"))
