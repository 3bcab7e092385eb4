"""Reviewing claims: seeded samples, labels of several readers, Wilson interval and gate."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.functions import text as T
from warpline.operators.origins import earliest

QUOTE = 200


def claims(phrases: DataFrame, carried: DataFrame, adoptions: DataFrame, coalitions: DataFrame) -> DataFrame:
    """One claim per carried phrase: stages, groups, earliest day (null if any is unknown), carriers, coalition."""
    rows = carried.join(adoptions, "amendment_id")
    groups = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter("author_groups", lambda g: g.isNotNull())))))
    per = rows.groupBy("phrase_id").agg(
        F.array_join(F.array_sort(F.collect_set("amendment_id")), ";").alias("amendment_ids"), F.array_join(F.array_sort(F.collect_set("stage")), ";").alias("stages"),
        F.array_join(groups, ";").alias("groups"), earliest(F.col("tabled_on")).alias("earliest_on"), F.countDistinct("amendment_id").alias("shared_by"),
    )
    joined = phrases.join(per, "phrase_id").join(coalitions.select("phrase_id").withColumn("coalition", F.lit(True)), "phrase_id", "left")
    return joined.select(
        F.concat(F.lit("claim:"), "phrase_id").alias("claim_id"), "phrase_id", "words", F.substring("text", 1, QUOTE).alias("phrase"), F.col("article_id").alias("provision"),
        "amendment_ids", "stages", "groups", "earliest_on", "shared_by", F.coalesce("coalition", F.lit(False)).alias("coalition"),
    )


def review_sample(claim_rows: DataFrame, n: int, seed: int = 0, strongest: int = 0) -> DataFrame:
    """Adds ``selection`` and ``draw``: ``n`` claims drawn with the seed, then the ``strongest`` others, longest first.

    The draw is that of Python's generator over the sorted ids, of which the driver holds a view's claims;
    ``hashed_sample`` draws from any number of rows.
    """
    if n < 1 or strongest < 0:
        raise ValueError("a review needs at least one claim, and no fewer than none of the strongest")
    ids = sorted((r["claim_id"], -r["words"]) for r in claim_rows.select("claim_id", "words").collect())
    drawn = random.Random(seed).sample([i for i, _ in ids], min(n, len(ids)))
    rest = sorted((w, i) for i, w in ids if i not in set(drawn))[:strongest]
    chosen = [(i, "sample", k) for k, i in enumerate(drawn)] + [(i, "strongest", len(drawn) + k) for k, (_, i) in enumerate(rest)]
    return claim_rows.join(claim_rows.sparkSession.createDataFrame(chosen, "claim_id string, selection string, draw int"), "claim_id")


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their key: repeatable, without holding the rows anywhere."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def _mulberry(seed: int):
    """A 32-bit generator of numbers in [0, 1), so that a draw can be repeated from its seed."""
    mask, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        x = ((state ^ state >> 15) * (state | 1)) & mask
        x ^= (x + ((x ^ x >> 7) * (x | 61) & mask)) & mask
        yield ((x ^ x >> 14) & mask) / 2**32


def draw_links(pool: list[str], size: int, seed: int) -> list[str]:
    """``size`` different entries of a small pool, by a partial shuffle with the seeded generator."""
    rest, numbers, out = list(pool), _mulberry(seed), []
    for i in range(min(size, len(rest))):
        j = i + int(next(numbers) * (len(rest) - i))
        rest[i], rest[j] = rest[j], rest[i]
        out.append(rest[i])
    return out


def label_problems(claim_ids: DataFrame, labels: DataFrame) -> DataFrame:
    """(problem, claim_id): labels of unknown claims, and readers who labelled a claim twice. Must be empty."""
    stray = labels.join(claim_ids, "claim_id", "left_anti").select(F.lit("stray").alias("problem"), "claim_id")
    twice = labels.groupBy("claim_id", "reader").count().where("count > 1").select(F.lit("twice").alias("problem"), "claim_id")
    return stray.unionByName(twice).distinct()


def claim_outcomes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``outcome``: unlabelled below two readers, real or not_real if all agree, else unresolved."""
    given = labels.groupBy("claim_id").agg(F.count(F.lit(1)).alias("readers"), F.collect_set("verdict").alias("verdicts"))
    one = (F.size("verdicts") == 1) & F.get("verdicts", F.lit(0)).isin("real", "not_real")
    outcome = F.when(F.coalesce("readers", F.lit(0)) < 2, "unlabelled").when(one, F.get("verdicts", F.lit(0))).otherwise("unresolved")
    return rows.join(given, "claim_id", "left").withColumn("outcome", outcome).drop("readers", "verdicts")


def summarise(outcomes: DataFrame) -> DataFrame:
    """One row: the sampled claims by outcome, precision with its Wilson interval, the strongest apart."""
    sampled, count = F.col("selection") == "sample", lambda c: F.count(F.when(c, 1))
    decided = F.col("outcome").isin("real", "not_real")
    rows = outcomes.agg(
        count(sampled).alias("claims"), count(sampled & decided).alias("resolved"), count(sampled & (F.col("outcome") == "real")).alias("real"),
        count(sampled & (F.col("outcome") == "unresolved")).alias("unresolved"), count(sampled & (F.col("outcome") == "unlabelled")).alias("unlabelled"),
        count(~sampled & (F.col("outcome") == "real")).alias("strongest_real"), count(~sampled & decided).alias("strongest_resolved"),
    )
    interval = T.wilson(F.col("real"), F.col("resolved"))
    return rows.withColumn("precision", F.try_divide(F.col("real"), F.col("resolved"))).withColumns({"low": interval["low"], "high": interval["high"]})


def gate(summary: DataFrame, floor: float, least: int) -> DataFrame:
    """Adds ``passed``: enough claims resolved, and the interval's lower end at the floor."""
    if least < 1 or not 0 <= floor <= 1:
        raise ValueError("the least must be at least 1 and the floor a share")
    return summary.withColumn("passed", (F.col("resolved") >= least) & (F.col("low") >= floor))
