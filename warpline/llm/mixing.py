"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source the keys are range-sorted: the key's leading
bits are its range, whose number follows the table's size, as hashed keys fill ranges evenly. Word
counts are summed per range and prefix-summed over a source's ranges, which finds the one range in
which the source's budget ends; only that range's documents are then sorted and prefix-summed one by
one. The result is one cut per source, a small table that decides about every document without
moving its text. A budget above a source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.llm.common import WORD, Scratch, column, fresh

WEIGHTS, MOST_EPOCHS, RANGE_ROWS = (5, 2, 1), 3, 50_000


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: str, seed: str) -> Column:
    """32 hex digits that depend on the id (null: empty) alone, so reruns and retries agree."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the whole size. A
    target stops at ``epochs`` times its source's size and the excess is shared by weight again:
    target = min(cap, level * weight), where the level is settled by going through the sources by
    cap per weight. One row per source, so these windows are over a table as long as the list of
    sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumns(
        {
            "rest": F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "rest_w": F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    own = F.col("rest").cast("double") / F.col("rest_w")
    level = F.min(F.when(F.col("cap") >= own * F.col("w"), F.struct(F.col("cap") / F.col("w"), own.alias("level")))).over(all_rows)["level"]
    return per.withColumn("level", level).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """The table of sizes and keys, and one row per source: target, whole epochs, and where the rest is cut.

    A document takes ``epochs`` times its size, once more if it sorts before the cut, and ``part``
    words more if it is at the cut.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    sized = scratch.save(sized.withColumn("key", random_key("doc_id", seed)), "sizes")
    plan = source_targets(sized).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0))
    plan = scratch.save(plan.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")), "targets")

    ranges = max(1, sized.count() // RANGE_ROWS)
    digits = len(f"{ranges:x}")
    same = F.col("s.source").eqNullSafe(F.col("p.source"))
    per_range = sized.groupBy("source", F.substring("key", 1, digits).alias("range")).agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("s.source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_range = per_range.alias("s").withColumn("upto", F.sum("size").over(upto))
    cut_range = (
        per_range.alias("s").join(plan.alias("p"), same)
        .where("s.size > 0 and p.rest >= s.upto - s.size and p.rest < s.upto")
        .select("p.source", "range", "rest", (F.col("upto") - F.col("s.size")).alias("before"))
    )
    inside = (
        sized.alias("s").join(cut_range.alias("p"), same & (F.substring("s.key", 1, digits) == F.col("p.range")))
        .groupBy("s.source", "key", "rest", "before").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    )
    upto = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        inside.withColumn("left", F.col("rest") - F.col("before") - F.sum("size").over(upto) + F.col("size"))
        .where("left >= 0 and left < size")
        .select("source", F.col("key").alias("cut_key"), F.expr("left div copies").alias("part"))
    )
    plan = plan.alias("s").join(cut.alias("p"), same, "left").select("s.*", "cut_key", "part")
    return sized, scratch.save(plan, "plan")


def taken_words(size: Column, key: Column, epochs: str = "epochs", cut_key: str = "cut_key", part: str = "part") -> Column:
    """From the columns of a plan row: a source without a cut takes whole epochs alone."""
    once = F.when(key < F.col(cut_key), size).when(key == F.col(cut_key), F.least(F.col(part), size)).otherwise(0)
    return (F.col(epochs) * size + once).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Null texts have size 0 and are not taken; a null source is a source of its own, the last one.
    Rows with the same id and source have the same key; where the cut falls on them they share what
    is left evenly. Reruns agree, as keys depend on ids alone. An empty table gives an empty result.
    """
    sized, plan = mix_plan(docs, id_col, source_col, text_col, seed)
    joined = sized.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    return joined.select("doc_id", "size", "source_size", "target", taken_words(F.col("size"), F.col("key")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """The mix itself: ``docs`` with a row for each time a document is taken, the last one cut to the words taken.

    Texts of which nothing is taken go, null and empty ones among them. Other columns are passed through, whatever their
    names. The plan has a row per source and is joined to the
    documents where they are, so no text is shuffled unless the plan is too large to broadcast.
    """
    _, plan = mix_plan(docs, id_col, source_col, text_col, seed)
    source, epochs, cut_key, part, size, key, taken, turn, text = fresh(docs.columns, "source", "epochs", "cut_key", "part", "size", "key", "taken", "turn", "text")
    plan = plan.select(F.col("source").alias(source), F.col("epochs").alias(epochs), F.col("cut_key").alias(cut_key), F.col("part").alias(part))
    inner = docs.withColumns({size: word_count(text_col), key: random_key(id_col, seed)})
    joined = inner.join(plan, F.col(source_col).eqNullSafe(F.col(source))).withColumn(taken, taken_words(F.col(size), F.col(key), epochs, cut_key, part))
    joined = joined.where(F.col(taken) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(taken) / F.col(size)))))
    words = F.least(F.col(size), F.col(taken) - (F.col(turn) - 1) * F.col(size))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(words < F.col(size), F.array_join(F.slice(pieces, 1, words.cast("int")), "")).otherwise(F.col(text_col))
    return joined.withColumn(text, cut).select(*[F.col(text).alias(c) if c == text_col else column(c) for c in docs.columns])


#: DuckDB SQL for mix_sources over the table documents: the same keys, sorted whole.
MIX_SQL = r"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('mix:' || coalesce(doc_id::varchar, '')) as key
    from documents
), per as (
    select source, sum(size)::bigint as source_size, list_extract([5, 2, 1], ((row_number() over (order by source nulls last) - 1) % 3 + 1)::int) as w
    from sized group by source
), ranked as (
    select *, source_size * 3 as cap,
        sum(source_size) over () - coalesce(sum(source_size * 3) over (order by source_size * 3 / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
        sum(w) over () - coalesce(sum(w) over (order by source_size * 3 / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest_w
    from per
), levelled as (
    select *, (select arg_min(rest::double / rest_w, (cap / w, rest::double / rest_w)) from ranked where cap >= rest::double / rest_w * w) as level from ranked
), targets as (
    select source, source_size, least(cap::double, level * w) as target from levelled
), budget as (
    select *, case when source_size > 0 then floor(round(target) / source_size)::bigint else 0 end as epochs from targets
), placed as (
    select s.doc_id, s.size, b.source_size, b.target, b.epochs, round(b.target)::bigint - b.epochs * b.source_size as rest,
        sum(s.size) over (partition by s.source order by s.key rows between unbounded preceding and current row) - s.size as before
    from sized s join budget b on s.source is not distinct from b.source
)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from placed
"""
