"""Entities: names to identities without risky merges, group membership by date, merged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions import text as T
from warpline.functions.udfs import matching_ratio

ENOUGH = 0.90
METHODS = ("register_id", "mep_id", "normalised_exact", "fuzzy", "acronym", "ambiguous", "unresolved")
CITIZENS = ("EU_CITIZEN", "NON_EU_CITIZEN")


def name_index(entries: DataFrame) -> DataFrame:
    """(register_id, name, key, scope, tokens, country): every usable name of (register_id, names, country).

    A name made of filler alone separates nothing and is left out.
    """
    names = entries.select("register_id", F.explode(F.array_distinct("names")).alias("name"), "country").where("name is not null")
    rows = names.select("register_id", "name", T.name_key(F.col("name")).alias("key"), T.scope_words(F.col("name")).alias("scope"), F.array_sort(F.array_distinct(T.name_tokens(F.col("name")))).alias("tokens"), "country")
    return rows.where(F.size("tokens") > 0)


def acronym_index(entries: DataFrame) -> DataFrame:
    """(key, ids): acronyms are shared by unrelated bodies, so they stay apart from names."""
    keyed = entries.select(T.name_key(F.col("acronym")).alias("key"), "register_id").where("key <> ''")
    return keyed.groupBy("key").agg(F.array_sort(F.collect_set("register_id")).alias("ids"))


def fuzzy_matches(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """(mention_id, score, ids): the entries tied on the best similarity of at least ``ENOUGH``.

    Only entries that share a word with the mention, could reach the similarity by their length, and are
    not of another known country are compared.
    """
    m = mentions.select("mention_id", F.array_sort(F.array_distinct(T.name_tokens(F.col("spelling")))).alias("mt"), F.col("country").alias("mc"))
    m = m.withColumns({"left": F.array_join("mt", " ")})
    i = index.select("register_id", F.array_join("tokens", " ").alias("right"), "tokens", F.col("country").alias("rc"))
    pairs = m.select("mention_id", "left", "mc", F.explode("mt").alias("t")).join(i.select("register_id", "right", "rc", F.explode("tokens").alias("t")), "t").drop("t").distinct()
    a, b = F.length("left"), F.length("right")
    possible = (2 * F.least(a, b) >= ENOUGH * (a + b)) & (F.col("mc").isNull() | F.col("rc").isNull() | (F.col("mc") == F.col("rc")))
    scored = pairs.where(possible).withColumn("score", matching_ratio("left", "right")).where(F.col("score") >= ENOUGH)
    best = scored.groupBy("mention_id").agg(F.max("score").alias("score"))
    return scored.join(best, ["mention_id", "score"]).groupBy("mention_id", "score").agg(F.array_sort(F.collect_set("register_id")).alias("ids"))


def resolve(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """(mention_id, actor_id, resolution, score, candidates) for mentions, by the most reliable evidence there is.

    ``mentions`` has (mention_id, spelling, register_id, user_type, country), ``entries``
    (register_id, names, acronym, country). Citizens share one actor; then a register id decides; a unique
    exact name that claims as much of Europe; several such, or one that claims more or less, are proposals; then an acronym; then
    similar names.
    """
    m = mentions.withColumns({"spelling": F.trim(F.regexp_replace(F.coalesce("spelling", F.lit("")), r"\s+", " ")), "code": T.usable_register_id(F.col("register_id"))})
    m = m.withColumns({"key": T.name_key(F.col("spelling")), "scope": T.scope_words(F.col("spelling"))})
    citizen = F.coalesce(F.col("user_type").isin(*CITIZENS), F.lit(False)) | ((F.col("spelling") == "") & F.col("code").isNull())
    index = name_index(entries)
    by_key = index.groupBy("key").agg(F.array_sort(F.collect_set("register_id")).alias("exact"), F.collect_set("scope").alias("scopes"))
    m = m.withColumn("citizen", citizen).join(by_key, "key", "left").join(acronym_index(entries).withColumnRenamed("ids", "by_acronym"), "key", "left")
    open_ = m.where(~F.col("citizen") & F.col("code").isNull() & F.col("exact").isNull() & F.col("by_acronym").isNull())
    fuzzy = fuzzy_matches(open_, index).select("mention_id", F.col("score").alias("near_score"), F.col("ids").alias("near"))
    m = m.join(fuzzy, "mention_id", "left")
    accepted = (F.size("exact") == 1) & F.array_contains("scopes", F.col("scope"))
    none = F.expr("cast(array() as array<string>)")
    proposed = F.coalesce(F.when(F.col("exact").isNotNull(), F.col("exact")), F.col("by_acronym"), F.col("near"), none)
    weak = F.when(F.col("exact").isNotNull(), "fuzzy").when(F.col("by_acronym").isNotNull(), "acronym").when(F.col("near").isNotNull(), "fuzzy").otherwise("unresolved")
    resolution = (
        F.when(F.col("citizen"), "unresolved").when(F.col("code").isNotNull(), "register_id").when(accepted, "normalised_exact")
        .when(F.size(proposed) > 1, "ambiguous").otherwise(weak)
    )
    scope_part = F.array_join(F.regexp_extract_all(F.lower("spelling"), F.lit(r"\b(europe|european|eu)\b"), F.lit(1)), " ")
    own_key = F.trim(F.concat_ws(" ", "key", scope_part))
    hashed = F.substring(F.sha2(F.when(own_key != "", own_key).otherwise(T.fold(F.col("spelling"))), 256), 1, 12)
    named = F.when((own_key != "") & own_key.rlike(r"^[\x00-\x7F]+$"), T.named_actor_id("source", own_key)).otherwise(T.named_actor_id("source", F.concat_ws(" ", own_key, hashed)))
    actor = (
        F.when(F.col("citizen"), "actor:citizens:aggregate").when(F.col("code").isNotNull(), T.register_actor_id(F.col("code")))
        .when(accepted, T.register_actor_id(F.get("exact", 0))).otherwise(named)
    )
    certain = F.col("citizen") | F.col("code").isNotNull() | accepted
    score = F.when(F.col("citizen"), F.lit(None)).when(F.col("code").isNotNull() | accepted | F.col("exact").isNotNull(), 1.0).when(F.col("by_acronym").isNull(), F.col("near_score"))
    return m.select("mention_id", actor.alias("actor_id"), resolution.alias("resolution"), score.alias("score"), F.when(certain, "").otherwise(F.array_join(proposed, ",")).alias("candidates"), F.col("citizen").alias("is_citizen"))


def resolution_summary(resolved: DataFrame) -> DataFrame:
    """(method, actors): every method, those without actors too, and citizens apart."""
    spark = resolved.sparkSession
    methods = spark.createDataFrame([(m,) for m in (*METHODS, "citizens")], "method string")
    counts = resolved.select(F.when(F.col("is_citizen"), "citizens").otherwise(F.col("resolution")).alias("method")).groupBy("method").agg(F.count(F.lit(1)).alias("actors"))
    return methods.join(counts, "method", "left").select("method", F.coalesce("actors", F.lit(0)).cast("long").alias("actors"))


def merge_actors(actors: DataFrame) -> DataFrame:
    """One row per actor_id: the record that sorts first as JSON, with everybody's aliases, sorted and once each."""
    fields = [c for c in actors.columns if c not in ("actor_id", "aliases")]
    record = F.struct(*fields)
    merged = actors.withColumn("_r", record).groupBy("actor_id").agg(
        F.min_by("_r", F.to_json("_r")).alias("_r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.expr("cast(array() as array<string>)")))))).alias("aliases")
    )
    return merged.select("actor_id", "_r.*", "aliases")


def group_on_day(events: DataFrame, spells: DataFrame, key: str) -> DataFrame:
    """Adds ``group`` to (event_id, key, day): the spell that covers the day and began last; open ends cover all, a null day nothing."""
    e, s = events.alias("e"), spells.alias("s")
    covers = (F.col("s.start").isNull() | (F.col("s.start") <= F.col("e.day"))) & (F.col("s.end").isNull() | (F.col("e.day") <= F.col("s.end")))
    joined = e.join(s, (F.col(f"e.{key}") == F.col(f"s.{key}")) & F.col("e.day").isNotNull() & covers)
    began = F.struct(F.coalesce(F.col("s.start"), F.lit("0001-01-01").cast("date")).alias("start"), F.col("s.group").alias("group"))
    latest = joined.groupBy("e.event_id").agg(F.max(began).alias("x")).select("event_id", F.col("x.group").alias("group"))
    return events.join(latest, "event_id", "left")


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """As-of join: each left row gets the last right row of its key at or before it, by one pass over their union.

    Needs one shuffle on the key and no range join, whatever the number of rows between.
    """
    marked = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    other = right.select(F.col(key), F.col(at), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    order = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marked.unionByName(other, allowMissingColumns=True).withColumn(f"last_{value}", F.last("_v", ignorenulls=True).over(order))
    return both.where("_side = 1").drop("_side", "_v")


def latest_value(spells: Column, key: str) -> Column:
    """The value of the spell that ends last, then begins last."""
    dated = F.transform(F.filter(spells, lambda s: s[key].isNotNull()), lambda s: F.struct(F.coalesce(s["end"], F.lit("")).alias("e"), F.coalesce(s["start"], F.lit("")).alias("s"), s[key].alias("v")))
    return F.array_max(dated)["v"]
