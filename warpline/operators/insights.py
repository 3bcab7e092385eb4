"""Summaries of a lineage view: organisations, channels, facets, filters, funnel, graph.

Inputs are the view's tables: phrases (phrase_id, article_id, words, text), origins (phrase_id,
document_id, organisation, actor_id, published_on, kind, eligibility, is_citation, amendment_ids), adoptions
(amendment_id, stage, committee, tabled_on, author_ids, author_groups, author_names), carried (phrase_id, amendment_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions import text as T

def _first() -> Column:
    return (F.col("eligibility") == "ask_first") & ~F.col("is_citation")


def rank_organisations(origins: DataFrame, phrases: DataFrame) -> DataFrame:
    """(org_key, name, adopted_first, adopted_first_lexical, adopted_first_semantic, tabled_only, reworded, documents, first_said, place).

    Counts different phrases that a named organisation asked for first. Reworded: only ever matched by meaning.
    """
    named = origins.where(_first() & F.col("organisation").isNotNull())
    adopted = phrases.select("phrase_id").distinct().withColumn("adopted", F.lit(True))
    named = named.join(adopted.hint("merge"), "phrase_id", "left").withColumn("org_key", F.coalesce("actor_id", F.concat(F.lit("name:"), F.col("organisation"))))
    per = named.groupBy("org_key", "phrase_id").agg(
        F.max(F.coalesce("adopted", F.lit(False))).alias("adopted"), F.max(F.col("kind") == "verbatim").alias("lexical"),
    )
    count = lambda c: F.count(F.when(c, 1))
    tallies = per.groupBy("org_key").agg(
        count(F.col("adopted")).alias("adopted_first"), count(F.col("adopted") & F.col("lexical")).alias("adopted_first_lexical"),
        count(F.col("adopted") & ~F.col("lexical")).alias("adopted_first_semantic"), count(~F.col("adopted")).alias("tabled_only"), count(~F.col("lexical")).alias("reworded"),
    )
    said = named.groupBy("org_key").agg(F.min("organisation").alias("name"), F.countDistinct("document_id").alias("documents"), F.min("published_on").alias("first_said"))
    order = Window.orderBy(F.desc("adopted_first"), F.desc("tabled_only"), "name", "org_key")
    return tallies.join(said, "org_key").withColumn("place", F.row_number().over(order))


def origin_totals(origins: DataFrame) -> DataFrame:
    """One row: unnamed documents that asked first, citations, matches that were not first."""
    return origins.agg(
        F.countDistinct(F.when(_first() & F.col("organisation").isNull(), F.col("document_id"))).alias("unnamed_documents"),
        F.count(F.when(F.col("is_citation"), 1)).alias("citations"),
        F.count(F.when(~F.col("is_citation") & (F.col("eligibility") != "ask_first"), 1)).alias("not_first"),
    )


def channel_counts(adoptions: DataFrame) -> DataFrame:
    """(dimension, label, n): different adopting amendments by stage, committee and year, in one pass.

    An amendment that stands there several times counts once.
    """
    one = adoptions.dropDuplicates(["amendment_id"])
    year = F.coalesce(F.date_format("tabled_on", "yyyy"), F.lit("Date unknown"))
    label = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("label"))
    labels = F.array(label("stage", F.col("stage")), label("committee", F.coalesce("committee", F.lit("Committee unknown"))), label("year", year))
    return one.select(F.explode(labels).alias("x")).groupBy("x.dimension", "x.label").agg(F.count(F.lit(1)).alias("n"))


def group_channels(adoptions: DataFrame) -> DataFrame:
    """One row: adopting amendments, those with a known group, those of two groups or more."""
    groups = F.size(F.array_distinct(F.filter("author_groups", lambda g: g.isNotNull())))
    one = adoptions.dropDuplicates(["amendment_id"])
    return one.agg(F.count(F.lit(1)).alias("adopting"), F.count(F.when(groups >= 1, 1)).alias("with_group"), F.count(F.when(groups >= 2, 1)).alias("cross_group"))


def match_timing(origins: DataFrame) -> DataFrame:
    """(timing, n): citations apart, the others by what their dates say."""
    timing = F.when(F.col("is_citation"), "citation").otherwise(F.col("eligibility"))
    return origins.groupBy(timing.alias("timing")).agg(F.count(F.lit(1)).alias("n"))


def phrase_facets(carried: DataFrame, adoptions: DataFrame) -> DataFrame:
    """(facet, value): groups and committees that carry a phrase."""
    rows = carried.select("amendment_id").distinct().join(adoptions, "amendment_id")
    groups = rows.select(F.lit("group").alias("facet"), F.explode("author_groups").alias("value"))
    return groups.unionByName(rows.select(F.lit("committee").alias("facet"), F.col("committee").alias("value"))).where("value is not null").distinct()


def phrase_haystacks(phrases: DataFrame, carried: DataFrame, adoptions: DataFrame, origins: DataFrame, searchable) -> DataFrame:
    """(phrase_id, groups, committees, kinds, asked_first, haystack): what a phrase can be found by."""
    flat = lambda name: F.array_distinct(F.flatten(F.collect_list(name)))
    by = carried.join(adoptions, "amendment_id").groupBy("phrase_id").agg(
        flat("author_groups").alias("groups"), F.collect_set("committee").alias("committees"), F.concat(F.collect_set("amendment_id"), flat("author_names")).alias("carrier_words")
    )
    said = origins.groupBy("phrase_id").agg(F.collect_set("kind").alias("kinds"), F.max(_first()).alias("asked_first"), F.collect_set("organisation").alias("organisations"))
    none = F.expr("cast(array() as array<string>)")
    rows = phrases.select("phrase_id", "text").join(by, "phrase_id", "left").join(said, "phrase_id", "left").fillna({"asked_first": False})
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("groups", "committees", "kinds", "organisations", "carrier_words")})
    hay = F.array_join(F.concat(F.array("text"), "carrier_words", "committees", "organisations"), "\n")
    return rows.select("phrase_id", "groups", "committees", "kinds", "asked_first", searchable(hay).alias("haystack"))


def filter_phrases(haystacks: DataFrame, query: str = "", group: str = "", committee: str = "", evidence: str = "") -> DataFrame:
    """The phrases that pass every filter that is set; all words of the (already folded) query must occur."""
    rows = haystacks
    if group:
        rows = rows.where(F.array_contains("groups", group))
    if committee:
        rows = rows.where(F.array_contains("committees", committee))
    rows = {
        "": lambda: rows, "first": lambda: rows.where("asked_first"), "any-origin": lambda: rows.where(F.size("kinds") > 0),
        "lexical": lambda: rows.where(F.array_contains("kinds", "verbatim")), "reworded": lambda: rows.where(F.array_contains("kinds", "semantic")),
    }[evidence]()
    for word in query.split():
        rows = rows.where(F.col("haystack").contains(word))
    return rows


def link_pool(phrases: DataFrame, origins: DataFrame) -> DataFrame:
    """Adopted phrases with a word-for-word origin that counts."""
    return phrases.join(origins.where(_first() & (F.col("kind") == "verbatim")), "phrase_id", "left_semi")


def by_evidence(phrases: DataFrame, origins: DataFrame) -> DataFrame:
    """Adds asked_first, has_origin and place: earlier requests first, then any origin, then longer, then id."""
    said = origins.groupBy("phrase_id").agg(F.max(_first()).alias("asked_first")).withColumn("has_origin", F.lit(True))
    rows = phrases.join(said, "phrase_id", "left").fillna({"asked_first": False, "has_origin": False})
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("asked_first"), F.desc("has_origin"), F.desc("words"), "phrase_id")))


def funnel(documents: DataFrame, origins: DataFrame, amendments: DataFrame, adoptions: DataFrame, units: DataFrame, ranking: DataFrame) -> DataFrame:
    """(step, part, whole): documents that asked first, by word and by meaning alone; amendments adopting; changed words linked; organisations."""
    first = origins.where(_first()).groupBy("document_id").agg(F.max(F.col("kind") == "verbatim").alias("lexical"))
    row = lambda df, step, part, whole: df.select(F.lit(step).alias("step"), part.cast("long").alias("part"), whole.cast("long").alias("whole"))
    docs = documents.agg(F.countDistinct("document_id").alias("whole")).crossJoin(first.agg(F.count(F.when(F.col("lexical"), 1)).alias("word"), F.count(F.when(~F.col("lexical"), 1)).alias("sense")))
    tabled = amendments.agg(F.countDistinct("amendment_id").alias("whole")).crossJoin(adoptions.agg(F.countDistinct("amendment_id").alias("part")))
    orgs = ranking.agg(F.count(F.lit(1)).alias("whole"), F.count(F.when(F.col("adopted_first") > 0, 1)).alias("part"))
    return (
        row(docs, "documents_lexical", F.col("word"), F.col("whole"))
        .unionByName(row(docs, "documents_semantic_only", F.col("sense"), F.col("whole")))
        .unionByName(row(tabled, "amendments_adopting", F.col("part"), F.col("whole")))
        .unionByName(row(units, "changed_words_linked", F.col("linked_units"), F.col("changed_units")))
        .unionByName(row(orgs, "organisations_adopted", F.col("part"), F.col("whole")))
    )


def tablers(adoptions: DataFrame, level: str = "member") -> DataFrame:
    """(amendment_id, tabler, label, detail): members or their groups; without authors the named ones, else the body's text."""
    body = F.coalesce("committee", "stage")
    node = lambda i, label, detail: F.struct(i.alias("tabler"), label.alias("label"), detail.cast("string").alias("detail"))
    text = F.array(node(F.concat(F.lit("tabler:text:"), body), F.concat(body, F.lit(" text, no Member named")), F.lit(None)))
    named = F.transform("author_names", lambda n: node(F.concat(F.lit("tabler:name:"), n), n, F.lit(None)))
    groups = F.transform(F.array_distinct(F.transform("author_groups", lambda g: F.coalesce(g, F.lit("Group unknown")))), lambda g: node(F.concat(F.lit("tabler:group:"), g), g, F.lit(None)))
    shown = F.transform("author_ids", lambda a, i: node(F.concat(F.lit("tabler:"), a), F.coalesce(F.get("author_names", i), a), F.get("author_groups", i)))
    authorless = F.when(F.size("author_names") > 0, named).otherwise(text) if level == "member" else text
    chosen = F.when(F.size("author_ids") == 0, authorless).otherwise(shown if level == "member" else groups)
    return adoptions.select("amendment_id", F.explode(chosen).alias("t")).select("amendment_id", "t.*")


def graph(origins: DataFrame, phrases: DataFrame, adoptions: DataFrame, level: str = "member", kinds: tuple[str, ...] = ("verbatim", "semantic")) -> DataFrame:
    """(source, target, source_column, target_column, source_label, target_label, phrase_id, lexical): supported links, one per phrase and kind of match.

    Organisation to who tabled a carrying amendment, and on to the provision; only what a named
    organisation asked for first.
    """
    said = origins.where(_first() & F.col("organisation").isNotNull() & F.col("kind").isin(*kinds))
    said = said.select("phrase_id", F.col("organisation").alias("org"), F.concat(F.lit("org:"), F.coalesce("actor_id", "organisation")).alias("org_id"), (F.col("kind") == "verbatim").alias("lexical"), F.explode(F.split("amendment_ids", ",")).alias("amendment_id"))
    paths = said.join(phrases.select("phrase_id", "article_id"), "phrase_id").join(tablers(adoptions, level), "amendment_id")
    left = paths.select(F.col("org_id").alias("source"), F.col("tabler").alias("target"), F.lit("organisation").alias("source_column"), F.lit("tabler").alias("target_column"), F.col("org").alias("source_label"), F.col("label").alias("target_label"), "phrase_id", "lexical")
    right = paths.select(F.col("tabler").alias("source"), F.concat(F.lit("prov:"), "article_id").alias("target"), F.lit("tabler").alias("source_column"), F.lit("provision").alias("target_column"), F.col("label").alias("source_label"), T.provision_label(F.col("article_id")).alias("target_label"), "phrase_id", "lexical")
    return left.unionByName(right).distinct()


def graph_edges(links: DataFrame) -> DataFrame:
    """(source, target, phrases, phrase_ids, lexical, semantic)."""
    ids = F.array_sort(F.collect_set("phrase_id"))
    return links.groupBy("source", "target").agg(F.size(ids).alias("phrases"), F.array_join(ids, ",").alias("phrase_ids"), F.max("lexical").alias("lexical"), F.max(~F.col("lexical")).alias("semantic"))


def graph_nodes(links: DataFrame) -> DataFrame:
    """(node, column, label, phrases): different phrases through each node."""
    end = lambda side: links.select(F.col(side).alias("node"), F.col(f"{side}_column").alias("column"), F.col(f"{side}_label").alias("label"), "phrase_id")
    return end("source").unionByName(end("target")).groupBy("node", "column").agg(F.min("label").alias("label"), F.countDistinct("phrase_id").alias("phrases"))


def slice_graph(links: DataFrame, limit: int, focus: str | None = None) -> DataFrame:
    """(node, column, label, phrases, place, hidden): the ``limit`` heaviest nodes of each column and how many more there are.

    With a focus only links that share its phrases count, and of its own column only itself; it is always shown.
    """
    if focus is not None:
        own = links.where((F.col("source") == focus) | (F.col("target") == focus)).select("phrase_id").distinct()
        column = graph_nodes(links).where(F.col("node") == focus).select(F.col("column").alias("own_column"))
        links = links.join(own, "phrase_id", "left_semi").crossJoin(column)
        other = lambda side: (F.col(f"{side}_column") == F.col("own_column")) & (F.col(side) != focus)
        links = links.where(~other("source") & ~other("target"))
    nodes = graph_nodes(links)
    pin = F.col("node") == focus if focus is not None else F.lit(False)
    order = Window.partitionBy("column").orderBy(F.desc(pin), F.desc("phrases"), "label", "node")
    ranked = nodes.withColumns({"place": F.row_number().over(order), "hidden": F.greatest(F.count(F.lit(1)).over(Window.partitionBy("column")) - limit, F.lit(0))})
    return ranked.where(F.col("place") <= limit)


def find_nodes(nodes: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """The heaviest nodes whose label holds what was typed, from two characters on."""
    if len(typed.strip()) < 2:
        return nodes.limit(0)
    return nodes.where(F.lower("label").contains(typed.strip().lower())).orderBy(F.desc("phrases"), "label").limit(limit)


def top_and_rest(counts: DataFrame, limit: int) -> DataFrame:
    """(label, n): the largest ``limit`` rows and the sum of the others as one."""
    ranked = counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
    label = F.when(F.col("place") <= limit, F.col("label")).otherwise("(rest)")
    return ranked.groupBy(label.alias("label")).agg(F.sum("n").alias("n"))


def ratio(part: Column, whole: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(part, whole)


def earlier(left: Column, right: Column) -> Column:
    return F.least(left, right)


def answers(ranking: DataFrame, channels: DataFrame, credit_rows: DataFrame) -> DataFrame:
    """(question, answer): the leading organisation, group, stage and committee."""
    first = lambda df, question, order, value: df.orderBy(*order).limit(1).select(F.lit(question).alias("question"), value.alias("answer"))
    top = lambda name: first(channels.where(F.col("dimension") == name), name, (F.desc("n"), "label"), F.col("label"))
    groups = credit_rows.where("holder_kind = 'group'")
    return (
        first(ranking, "organisation", ("place",), F.col("name")).unionByName(first(groups, "group", (F.desc("phrases"), "holder_id"), F.col("name"))).unionByName(top("stage")).unionByName(top("committee"))
    )


def coverage_line(status: Column, count: Column, reason: Column) -> Column:
    """A layer's coverage in words."""
    shown = F.when(count.isNotNull(), F.concat(F.lit(" ("), count.cast("string"), F.lit(")"))).otherwise("")
    why = F.when(reason.isNotNull(), F.concat(F.lit(": "), reason)).otherwise("")
    return F.concat(F.regexp_replace(status, "_", " "), shown, why)


def prepared(phrases: DataFrame, carried: DataFrame, adoptions: DataFrame, origins: DataFrame) -> DataFrame:
    """Phrases with their amendments and origins nested, an origin once per document, kind and place, best evidence first."""
    amendment = F.struct("amendment_id", "stage", "committee", "tabled_on", T.author_labels(F.col("author_names"), F.col("author_ids"), F.col("author_groups")).alias("authors"))
    by = carried.join(adoptions, "amendment_id").groupBy("phrase_id").agg(F.array_sort(F.collect_set(amendment)).alias("amendments"))
    once = origins.dropDuplicates(["phrase_id", "document_id", "kind", "first", "end"])
    said = once.groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("document_id", "organisation", "published_on", "first", "end", "kind", "eligibility", "is_citation"))).alias("origins"), F.max(_first()).alias("asked_first"))
    rows = phrases.join(by, "phrase_id", "left").join(said, "phrase_id", "left").fillna({"asked_first": False})
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.coalesce(c, F.expr(f"cast(array() as {kinds[c]})")) for c in ("amendments", "origins")})


def search_organisations(ranking: DataFrame, typed: str, limit: int = 10) -> DataFrame:
    """Names that hold what was typed, whatever its case."""
    name = "organisation" if "organisation" in ranking.columns else "name"
    return ranking.where(F.lower(name).contains(typed.strip().lower())).orderBy(name).limit(limit)


def problem_counts(problems: DataFrame) -> DataFrame:
    """(code, line): how often each kind of gap occurred, in words."""
    counts = problems.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("code", F.concat_ws(" ", F.col("n").cast("string"), "code").alias("line"))


def top_members(credit_rows: DataFrame, limit: int = 10) -> DataFrame:
    """The members a run's summary names."""
    return credit_rows.where("holder_kind = 'mep'").orderBy(F.desc("phrases"), F.desc("amendments"), "holder_id").limit(limit)
