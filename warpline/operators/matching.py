"""Shared wording: window joins, runs, intervals and the rarity of words.

Joins of windows, places and runs are told to merge: the planner takes exploded and gathered rows for as small as those they are made of,
and would have the driver gather and broadcast them.
"""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions import text as T
from warpline.operators.meeting import meeting, meeting_places

RARE_SHARE, RARE_WORDS = 0.05, 3


def with_words(texts: DataFrame, text_col: str = "text", name: str = "w") -> DataFrame:
    return texts.withColumn(name, T.words(F.coalesce(F.col(text_col), F.lit(""))))


def exploded_windows(rows: DataFrame, *keys: str, word_col: str = "w", at: str = "at", mask_col: str | None = None, within: Broadcast | None = None) -> DataFrame:
    """(keys, at, gram) of every window of the word arrays; with a mask, of those that hold a true place; with a bitmap of ``meeting``, of those it may hold."""
    places = None
    if within is not None:
        rows, places = rows.withColumn("_places", meeting_places(F.col(word_col), within)), F.col("_places")
    grams = T.windows(F.col(word_col), mask=F.col(mask_col) if mask_col else None, places=places)
    return rows.select(*keys, F.explode(grams).alias("x")).select(*keys, F.col("x.at").alias(at), F.col("x.gram").alias("gram"))


def _stages(article_words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The final act's provisions and the proposal's."""
    return article_words.where("stage = 'final_act'"), article_words.where("stage = 'proposal'")


def novel_windows(article_words: DataFrame, within: Broadcast | None = None) -> DataFrame:
    """(article_id, at, gram): windows of the final act that no proposal provision holds; with a bitmap of ``meeting``, those it may hold."""
    final, drafted = _stages(article_words)
    drafted = exploded_windows(drafted, "article_id", within=within).select("gram").distinct()
    return exploded_windows(final, "article_id", within=within).join(drafted.hint("merge"), "gram", "left_anti").select("article_id", "at", "gram")


def novel_places(article_words: DataFrame) -> DataFrame:
    """(article_id, at): where the windows of ``novel_windows`` begin. Only windows that the proposal may hold are compared with it."""
    final, drafted = _stages(article_words)
    within = meeting(final, drafted)
    seen = final.withColumns({"_places": meeting_places(F.col("w"), within), "_n": F.greatest(F.size("w") - T.WINDOW + 1, F.lit(0))})
    every = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    apart = seen.select("article_id", F.explode(F.array_except(every, "_places")).alias("at"))
    return apart.unionByName(novel_windows(article_words, within).select("article_id", "at"))


def word_frequencies(article_words: DataFrame) -> DataFrame:
    """(word, provisions, total, common): in how many provisions of any stage a word stands.

    A word is common from two provisions and a twentieth of them all on.
    """
    counts = article_words.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("provisions"))
    total = article_words.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(total).withColumn("common", F.col("provisions") >= F.greatest(F.lit(2.0), RARE_SHARE * F.col("total")))


def common_words(article_words: DataFrame) -> DataFrame:
    """(word): at most twenty times as many as a provision's words on average, by the share each must reach."""
    return word_frequencies(article_words).where("common").select("word")


def significant(runs: DataFrame, common: DataFrame, words_col: str = "run_words") -> DataFrame:
    """The rows of ``runs`` whose words hold enough different words that are not common.

    The common words are one row with an array: a word is common from a twentieth of the provisions on, so
    there are at most twenty times as many as a provision has different words on average. So runs are
    computed once and not joined with themselves.
    """
    one = common.agg(F.collect_set("word").alias("_common"))
    rare = F.size(F.array_except(F.array_distinct(words_col), "_common"))
    return runs.crossJoin(one).where(rare >= RARE_WORDS).drop("_common")


def islands(hits: DataFrame, *keys: str, at: str = "at") -> DataFrame:
    """(keys, first, last): maximal stretches of consecutive ``at`` within ``keys``; repeated places count once."""
    order = Window.partitionBy(*keys).orderBy(at)
    numbered = hits.select(*keys, at, (F.col(at) - F.dense_rank().over(order)).alias("island"))
    return numbered.groupBy(*keys, "island").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("island")


def place_intervals(places: DataFrame) -> DataFrame:
    """(article_id, first, end) of distinct (article_id, position) rows, merged where consecutive."""
    return islands(places.distinct(), "article_id", at="position").select("article_id", "first", (F.col("last") + 1).alias("end"))


def longest_runs(hits: DataFrame, common: DataFrame, word_rows: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, first, end, words): the longest significant run of each pair.

    ``hits`` holds (left, right, at, other_at): a window of the left text at ``at`` that stands in the
    right one at ``other_at``. Hits on one diagonal merge where consecutive. Of equally long runs
    the one on the diagonal that was met first wins, then the earlier one. ``word_rows`` has the left texts' words ``w``.
    """
    diagonal = Window.partitionBy(left, right, "diagonal")
    stretches = islands(hits.select(left, right, "at", (F.col("at") - F.col("other_at")).alias("diagonal")), left, right, "diagonal")
    runs = stretches.withColumn("met", F.min("first").over(diagonal)).withColumns({"met_other": F.col("met") - F.col("diagonal"), "end": F.col("last") + T.WINDOW})
    runs = runs.join(word_rows.select(left, "w").hint("merge"), left).withColumn("run_words", F.slice("w", F.col("first") + 1, F.col("end") - F.col("first"))).drop("w")
    kept = significant(runs, common)
    best = Window.partitionBy(left, right).orderBy(F.desc(F.col("end") - F.col("first")), "met", "met_other", "first")
    return kept.withColumn("place", F.row_number().over(best)).where("place = 1").select(left, right, "first", "end", (F.col("end") - F.col("first")).alias("words"), "run_words")


def reaches(spans: Column) -> Column:
    """array<struct<start, last>> of the greedy runs over sorted ``spans`` (structs of first and last).

    A run begins at the first place that no run has yet and goes as far as the longest span that holds
    its beginning. ``next`` is the last place of the longest span seen that holds the place after the open run.
    """
    run = "struct<start:int,last:int>"
    start = F.struct(*(F.lit(None).cast("int").alias(n) for n in ("start", "last", "next")), F.expr(f"cast(array() as array<{run}>)").alias("done"))

    def closed(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["start"], acc["last"])))

    def state(begin: Column, last: Column, following: Column, done: Column) -> Column:
        return F.struct(begin.cast("int").alias("start"), last.cast("int").alias("last"), following.cast("int").alias("next"), done.cast(f"array<{run}>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        longer, here = F.greatest(acc["next"], x["last"]), x["first"]
        moved = F.struct((acc["last"] + 1).alias("start"), acc["next"].alias("last"))
        both = F.concat(closed(acc), F.array(moved))
        return (
            F.when(acc["start"].isNull(), state(here, x["last"], x["last"], acc["done"]))
            .when(here == acc["start"], state(here, F.greatest(acc["last"], x["last"]), longer, acc["done"]))
            .when(here <= acc["last"] + 1, state(acc["start"], acc["last"], longer, acc["done"]))
            .when(acc["next"] <= acc["last"], state(here, x["last"], x["last"], closed(acc)))
            .when(here <= acc["next"] + 1, state(moved["start"], moved["last"], longer, closed(acc)))
            .otherwise(state(here, x["last"], x["last"], both))
        )

    def ended(acc: Column) -> Column:
        rest = F.when(acc["next"] > acc["last"], F.array(F.struct((acc["last"] + 1).alias("start"), acc["next"].alias("last"))))
        return F.when(acc["start"].isNull(), acc["done"]).otherwise(F.concat(closed(acc), F.coalesce(rest, F.expr(f"cast(array() as array<{run}>)"))))

    return F.aggregate(spans, start, step, ended)


def fold_runs(hits: DataFrame, key: str) -> DataFrame:
    """(key, start, last, diagonals): the greedy runs of the windows that hit.

    ``hits`` holds (key, at, article_id, other_at). Each window has the set of its diagonals (article,
    shift). A run goes on while the next window shares a diagonal with all of it, and keeps the shared
    ones alone; otherwise the next window begins a run of its own. A window without hits ends a run.

    So a run goes as far as the longest stretch on one diagonal that holds its beginning, and keeps the diagonals
    of the stretches that end with it. Only the different ends of stretches of a key meet in one row, not its windows.
    """
    shifted = hits.select(key, "at", "article_id", (F.col("other_at") - F.col("at")).alias("shift"))
    stretches = islands(shifted, key, "article_id", "shift")
    ends = stretches.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")))).alias("spans"))
    runs = ends.select(key, F.explode(reaches(F.col("spans"))).alias("run")).select(key, "run.start", "run.last")
    held = stretches.join(runs.hint("merge"), [key, "last"]).where(F.col("first") <= F.col("start"))
    diagonals = F.array_sort(F.collect_list(F.struct("article_id", "shift"))).alias("diagonals")
    return held.groupBy(key, "start", "last").agg(diagonals)
