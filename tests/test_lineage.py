"""The lineage operators against plain Python on small records."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from warpline.operators import adoption as A
from warpline.operators import entities as E
from warpline.operators import insights as I
from warpline.operators import matching as M
from warpline.operators import origins as O
from warpline.operators import review as R
from warpline.operators import search as S
from warpline.operators.meeting import meeting
from warpline.plans.lineage import Lineage


def plain_fold(steps):
    """Runs of (at, set of diagonals): go on while some diagonal is shared by all."""
    runs, cur, start, last = [], None, 0, 0
    for at, found in steps:
        if cur is not None and at == last + 1 and cur & found:
            cur, last = cur & found, at
            continue
        if cur is not None:
            runs.append((start, last, frozenset(cur)))
        cur, start, last = found, at, at
    return runs + ([(start, last, frozenset(cur))] if cur is not None else [])


def test_fold_keeps_what_all_windows_share(spark):
    rng = random.Random(1)
    hits, expected = [], set()
    for key in range(300):
        steps = []
        for at in sorted(rng.sample(range(20), rng.randint(1, 14))):
            found = {(rng.choice("pq"), rng.randint(0, 2)) for _ in range(rng.randint(1, 3))}
            steps.append((at, found))
            hits += [(key, at, a, at + s) for a, s in found]
        expected |= {(key, *r) for r in plain_fold(steps)}
    got = M.fold_runs(spark.createDataFrame(hits, "k int, at int, article_id string, other_at int"), "k").collect()
    assert {(r.k, r.start, r.last, frozenset((d.article_id, d.shift) for d in r.diagonals)) for r in got} == expected


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


@pytest.fixture(scope="module")
def world(spark):
    new, old, other = words(40, 1), words(40, 2), words(60, 3)
    articles = [("f1", "final_act", " ".join(old[:10] + new[:20] + old[10:20])), ("f2", "final_act", " ".join(other[:15] + new[20:32])), ("p1", "proposal", " ".join(old)), ("p2", "proposal", "the law of the land is the law")]
    amendments = [
        ("am1", ["m1", "m2"], [], ["g1", None], "committee", "X", "2024-01-10", None, " ".join(["zz"] + new[:14])),
        ("am2", ["m3"], [], ["g2"], "plenary", "X", None, " ".join(old[:10]), " ".join(old[:5] + new[5:18] + old[5:10])),
        ("am3", [], ["on behalf of the Green Group", "Jane Doe"], [], "plenary", None, "2024-01-05", None, " ".join(new[20:32])),
        ("am4", [], [], [], "committee", "Y", "2024-02-01", None, " ".join(new[20:30]) + " " + " ".join(words(9, 8))),
        ("am5", ["m1"], [], ["g1"], "committee", "X", "2024-01-20", None, " ".join(words(30, 9))),
    ]
    documents = [("d1", "2024-01-01", "Org A", " ".join(["pre"] + new[:14])), ("d2", "2024-01-15", None, " ".join(new[20:32])), ("d3", None, "Org B", " ".join(new[2:12])), ("d4", "2023-01-01", "Org C", " ".join(words(30, 9)[3:20])), ("d5", "2023-01-01", "Org D", " ".join(old))]
    day = lambda df, c: df.withColumn(c, F.to_date(c))
    return Lineage(
        spark.createDataFrame(articles, "article_id string, stage string, text string"),
        day(spark.createDataFrame(amendments, "amendment_id string, author_ids array<string>, author_names array<string>, author_groups array<string>, stage string, committee string, tabled_on string, old_text string, new_text string"), "tabled_on"),
        day(spark.createDataFrame(documents, "document_id string, published_on string, organisation string, text string"), "published_on"),
        keep=True,
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_adopted_wording(world):
    place = lambda *x: "phrase:" + hashlib.sha256(("place:" + ":".join(map(str, x))).encode()).hexdigest()[:16]
    one, two = place("f1", 10, 28), place("f2", 15, 27)
    assert rows(world.phrases, "phrase_id", "words") == sorted([(one, 18), (two, 12)])
    assert rows(world.carried, "phrase_id", "amendment_id") == sorted([(one, "am1"), (one, "am2"), (two, "am3"), (two, "am4")])
    quoted = {r.phrase_id: r.quote for r in A.quoted_phrases(world.phrases, world.articles).collect()}
    assert quoted[two] == " ".join(words(40, 1)[20:32])
    adoptions = {r.amendment_id: r for r in A.amendment_adoptions(world.runs, world.carried, world.amendment_words).collect()}
    assert (adoptions["am1"].adopted_words, adoptions["am1"].longest_run, adoptions["am1"].new_words, adoptions["am1"].inserted_words) == (14, 14, 15, 15)
    assert adoptions["am2"].inserted_words == 13 and adoptions["am2"].longest_run == 13
    assert tuple(A.unit_counts(world.runs, world.article_words).first())[1] == 30


def test_credit_rules(world):
    got = {(r.holder_id, r.holder_kind): (r.phrases, r.joint_phrases, r.amendments, r.amendments_tabled) for r in world.credits.collect()}
    assert got[("m1", "mep")] == (1, 1, 1, 2) and got[("m3", "mep")] == (1, 1, 1, 1)
    assert got[("g1", "group")] == (1, 1, 1, 2) and got[("Green", "group")] == (1, 0, 1, 1)
    assert got[("name:Jane Doe", "unresolved")] == (1, 1, 1, 1)
    assert not any(kind == "committee_text" for _, kind in got)
    assert A.phrases_without_group(world.carried, world.tablers).first()[0] == 0  # a named group counts
    assert [r.groups for r in A.coalition_phrases(world.carried, world.tablers).collect()] == [2]


def test_origins_and_their_order(world):
    got = {(r.document_id, r.words): r for r in world.origins.collect()}
    assert got[("d1", 14)].precedes is None and got[("d1", 14)].eligibility == "unknown_date"  # am2 has no day
    assert got[("d2", 12)].precedes is True and got[("d2", 12)].amendment_ids == "am3,am4" or got[("d2", 12)].eligibility == "amendment_first"
    assert got[("d3", 10)].eligibility == "unknown_date" and len(got) == 3
    phrases, origins = world.tabled
    assert [(r.words, r.amendment_ids) for r in phrases.collect()] == [(17, "am5")]
    assert [(r.document_id, r.eligibility) for r in origins.collect()] == [("d4", "ask_first")]
    assert O.dangling(world.phrases, phrases, world.origins, world.carried, world.amendments).collect() == []
    assert O.uncarried(world.phrases, world.carried).collect() == []


def test_insights(world):
    ranking = world.ranking.collect()
    assert [(r.name, r.adopted_first, r.tabled_only) for r in ranking if r.tabled_only] == [("Org C", 0, 1)]
    channels = {(r.dimension, r.label): r.n for r in I.channel_counts(world.adoptions).collect()}
    assert channels[("stage", "plenary")] == 2 and channels[("committee", "Committee unknown")] == 1 and channels[("year", "Date unknown")] == 1
    assert tuple(I.group_channels(world.adoptions).first()) == (4, 2, 0)
    labels = {r.label for r in I.tablers(world.adoptions).collect()}
    assert {"m1", "Jane Doe", "Y text, no Member named"} <= labels
    groups = {r.label for r in I.tablers(world.adoptions, "group").collect()}
    assert {"g1", "Group unknown", "g2", "plenary text, no Member named", "Y text, no Member named"} == groups


def test_status(spark):
    frame = lambda *stages: spark.createDataFrame([(s,) for s in stages], "stage string")
    assert A.adoption_status(frame("final_act", "proposal")).first().status == "computed"
    assert "final act" in A.adoption_status(frame("proposal")).first().reason
    assert "proposal" in A.adoption_status(frame("final_act")).first().reason


def test_recorded_groups(spark):
    rows_ = spark.createDataFrame([("a", ["m1", "m2"], ["g", None]), ("b", ["m1", "m3"], [])], "amendment_id string, author_ids array<string>, author_groups array<string>")
    latest = spark.createDataFrame([("m1", "new")], "author_id string, group string")
    assert sorted((r.amendment_id, r.author_id, str(r.group)) for r in A.recorded_groups(rows_, latest).collect()) == [("a", "m1", "g"), ("a", "m2", "None"), ("b", "m1", "new"), ("b", "m3", "None")]


def test_groups_by_day(spark):
    spells = spark.createDataFrame([("m", "old", None, "2020-01-01"), ("m", "new", "2020-01-01", None), ("m", "tie", "2020-01-01", None)], "k string, group string, start string, end string")
    spells = spells.withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    events = spark.createDataFrame([(1, "m", "2019-05-05"), (2, "m", "2020-01-01"), (3, "m", None), (4, "n", "2020-01-01")], "event_id int, k string, day string").withColumn("day", F.to_date("day"))
    assert {r.event_id: r.group for r in E.group_on_day(events, spells, "k").collect()} == {1: "old", 2: "tie", 3: None, 4: None}


def test_bm25_against_plain_sums(spark):
    import math

    rng = random.Random(7)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(40)]
    asked = [["a", "b", "a"], ["h"], ["zz"], []]
    frame = spark.createDataFrame([(str(i), i, w) for i, w in enumerate(docs)], "passage_id string, place int, w array<string>")
    queries = spark.createDataFrame([(str(i), q) for i, q in enumerate(asked)], "query_id string, terms array<string>")
    got = sorted((r.query_id, r["rank"], r.passage_id, round(r.score, 9)) for r in S.bm25(frame, queries, 4).collect())
    average, expected = sum(map(len, docs)) / len(docs), []
    for q, terms in enumerate(asked):
        scores = []
        for i, d in enumerate(docs):
            s = 0.0
            for t in sorted(set(terms)):
                if t in d:
                    df = sum(t in x for x in docs)
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / average))
            if s > 0:
                scores.append((-s, i))
        expected += [(str(q), n, str(i), round(-s, 9)) for n, (s, i) in enumerate(sorted(scores)[:4], 1)]
    assert got == sorted(expected)


def test_resolution_cascade(spark):
    entries = spark.createDataFrame(
        [("111111-11", ["Alpha Energy GmbH", None], "AE", "DEU"), ("222222-22", ["Beta Union"], "BU", None), ("333333-33", ["Gamma Works"], "BU", None), ("444444-44", ["Gamma Works"], None, None), ("555555-55", ["European Union"], None, None)],
        "register_id string, names array<string>, acronym string, country string",
    )
    mentions = spark.createDataFrame(
        [
            (1, "alpha energy", None, None, None), (2, "European Beta Union", None, None, None), (3, "Gamma Works", None, None, None), (4, "AE", None, None, None), (5, "BU", None, None, None), (6, "Alpha Enery", None, None, "DEU"),
            (7, "Alpha Enery", None, None, "FRA"), (8, "x", " 999999-99 ", None, None), (9, "Someone", None, "EU_CITIZEN", None), (10, " ", "bad", None, None), (11, "Ωmega", None, None, None),
        ],
        "mention_id int, spelling string, register_id string, user_type string, country string",
    )
    got = {r.mention_id: (r.actor_id, r.resolution, r.candidates) for r in E.resolve(mentions, entries).collect()}
    assert got[1] == ("actor:tr:111111-11", "normalised_exact", "") and got[2][1:] == ("fuzzy", "222222-22") and got[3][1:] == ("ambiguous", "333333-33,444444-44")
    assert got[4][1:] == ("acronym", "111111-11") and got[5][1:] == ("ambiguous", "222222-22,333333-33") and got[6][1:] == ("fuzzy", "111111-11") and got[7][1] == "unresolved"
    assert got[8][:2] == ("actor:tr:999999-99", "register_id") and got[9][0] == got[10][0] == "actor:citizens:aggregate"
    assert got[2][0] == "actor:name:source.beta-union-european" and len(got[11][0].rsplit("-", 1)[-1]) == 12
    summary = {r.method: r.actors for r in E.resolution_summary(E.resolve(mentions, entries)).collect()}
    assert summary["citizens"] == 2 and summary["mep_id"] == 0 and sum(summary.values()) == 11


def test_review(spark):
    claims = spark.createDataFrame([(f"claim:{i:02}", i) for i in range(20)], "claim_id string, words int")
    drawn = R.review_sample(claims, 5, seed=3, strongest=2).collect()
    expected = random.Random(3).sample(sorted(f"claim:{i:02}" for i in range(20)), 5)
    assert [r.claim_id for r in sorted(drawn, key=lambda r: r.draw)][:5] == expected and sum(r.selection == "strongest" for r in drawn) == 2
    verdicts = [("a", "x", "real"), ("a", "y", "real"), ("b", "x", "real"), ("b", "y", "unclear"), ("c", "x", "not_real"), ("d", "x", "unclear"), ("d", "y", "unclear")]
    labels = spark.createDataFrame(verdicts, "claim_id string, reader string, verdict string")
    outcomes = R.claim_outcomes(spark.createDataFrame([(c, "sample") for c in "abcde"], "claim_id string, selection string"), labels)
    assert {r.claim_id: r.outcome for r in outcomes.collect()} == {"a": "real", "b": "unresolved", "c": "unlabelled", "d": "unresolved", "e": "unlabelled"}
    assert R.gate(R.summarise(outcomes), 0.2, 1).first().passed and not R.gate(R.summarise(outcomes), 0.2, 2).first().passed
    with pytest.raises(ValueError):
        R.review_sample(claims, 0)
    assert R.draw_links(list("abcdef"), 3, 5) == R.draw_links(list("abcdef"), 3, 5) and len(set(R.draw_links(list("abc"), 9, 1))) == 3
    assert R.hashed_sample(claims, "claim_id", 4, 1).count() == 4


def test_merged_actors(spark):
    frame = spark.createDataFrame([("1", "B", ["x"]), ("1", "A", ["y", "x"]), ("2", "C", None)], "actor_id string, name string, aliases array<string>")
    assert sorted((r.actor_id, r.name, r.aliases) for r in E.merge_actors(frame).collect()) == [("1", "A", ["x", "y"]), ("2", "C", [])]


def test_islands_of_repeated_places(spark):
    frame = spark.createDataFrame([("a", p) for p in (1, 2, 2, 3, 7, 8)] + [("b", 1)], "article_id string, position int")
    assert sorted(map(tuple, M.place_intervals(frame).collect())) == [("a", 1, 4), ("a", 7, 9), ("b", 1, 2)]


def test_alias_conflicts(spark):
    queries = spark.createDataFrame([(1, "ai act"), (2, "both"), (3, "gone"), (4, "free text")], "query_id int, key string")
    aliases = spark.createDataFrame([("ai act", "t1"), ("both", "t1"), ("both", "t2"), ("gone", "t9")], "key string, title_id string")
    titles = spark.createDataFrame([("ai act", "t1"), ("x", "t2"), ("free text", "t3")], "key string, title_id string")
    assert {r.query_id: (r.status, r.title_ids) for r in S.by_alias(queries, aliases, titles).collect()} == {1: ("chosen", "t1"), 2: ("ambiguous", "t1,t2"), 3: ("missing", "t9")}


def test_origins_come_longest_first(spark):
    given = [("d2", "p1", 9), ("d1", "p2", 9), ("d1", "p1", 9), ("d9", "p9", 30), ("d0", "p0", 8)]
    found = O.ordered(spark.createDataFrame(given, "document_id string, phrase_id string, words int")).collect()
    assert [(r.document_id, r.phrase_id) for r in found] == [("d9", "p9"), ("d1", "p1"), ("d1", "p2"), ("d2", "p1"), ("d0", "p0")]


def test_windows_that_cannot_meet_are_not_dealt(spark):
    rng = random.Random(5)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    common = text()
    left = [common[:20] + text(), [], ["a"] * 7, text() + common[10:30]]
    right = [text(), text()[:5] + common + text(), common[:8]]
    one, two = (spark.createDataFrame(list(enumerate(x)), "id int, w array<string>").repartition(3) for x in (left, right))
    within = meeting(one, two)
    grams = lambda rows: {(i, k, " ".join(w[k : k + 8])) for i, w in enumerate(rows) for k in range(len(w) - 7)}
    shared = {g for *_, g in grams(left)} & {g for *_, g in grams(right)}
    for df, rows in ((one, left), (two, right)):
        got = {(r.id, r.at, r.gram) for r in M.exploded_windows(df, "id", within=within).collect()}
        assert got == {x for x in grams(rows) if x[2] in shared} and got  # no chance hit among so few
        assert {tuple(x) for x in M.exploded_windows(df, "id").collect()} == grams(rows)


def test_novel_places_are_those_of_the_novel_windows(spark):
    rng = random.Random(6)
    texts = [[rng.choice("abc") for _ in range(n)] for n in (400, 300, 7, 0, 8, 500)]
    rows = [(f"{i}", "proposal" if i % 2 else "final_act", w) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "article_id string, stage string, w array<string>")
    drafted = {tuple(w[k : k + 8]) for _, s, w in rows if s == "proposal" for k in range(len(w) - 7)}
    expected = sorted((i, k) for i, s, w in rows if s == "final_act" for k in range(len(w) - 7) if tuple(w[k : k + 8]) not in drafted)
    assert sorted(map(tuple, M.novel_places(df).collect())) == expected
    assert sorted(map(tuple, M.novel_windows(df).select("article_id", "at").collect())) == expected


def test_kept_tables_cut_the_plan(world):
    for name in ("runs", "phrases", "carried", "origins", "tabled_runs", "all_origins", "units"):
        plan = getattr(world, name)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan, name


def test_growing_sides_are_never_broadcast(world):
    drafted = world.article_words.where("stage = 'proposal'")
    made = (
        A.adopted_runs(world.amendment_words, world.article_words, world.common), A.adopted_phrases(world.runs, world.article_words), A.carriers(world.runs, world.phrases),
        O.phrase_runs(world.phrases, world.document_words, world.common), O.tabled_runs(world.amendment_words, drafted, world.document_words, world.common),
        O.unadopted_runs(world.tabled_runs, world.phrases), *O.tabled_origins(world.tabled_runs, world.documents, world.amendments),
    )
    for df in made:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_credits_compare_digests_of_wordings(world):
    assert {len(r.wording) for r in world.wording.collect()} == {64}


def test_dangling_broadcasts_nothing_and_finds_all(world, spark):
    both = world.phrases.limit(1).select("phrase_id").collect()[0][0]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "phrase_id string")
    found = O.dangling(world.phrases, ids(both), ids(both, "gone"), world.carried, world.amendments)
    assert {(r.problem, r.key) for r in found.collect()} == {("adopted and tabled", both), ("origin without phrase", "gone")}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()


def test_ranking_broadcasts_no_phrases(world):
    plan = I.rank_organisations(world.all_origins, world.phrases)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [phrase_id" in plan and "BroadcastHashJoin [phrase_id" not in plan
