"""Acts: identifiers, streams, and XHTML to provisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions import text as T
from warpline.functions.udfs import html_blocks

# Element classes and wording by which the parts of an act are known.
TITLE_CLASSES = ("oj-ti-art", "oj-sti-art")
HEADING_CLASSES = ("SectionTitle", "ChapterTitle", "Titrearticle", "Articletitle")
DATE_CLASS = "oj-hd-date"
ELI = r"^(rct|art|anx)_([0-9A-Za-z]+)$"
MARKER = r"^(?:\(\w{1,6}\)|\w{1,4}[.)]|[—–-])$"
ARTICLE, ANNEX = r"^Article\s+(\d+[a-z]{0,2})$", r"^ANNEX(?:\s+([IVXLC]+|\d+[a-z]?))?$"
RECITAL, PARAGRAPH = r"^\((\d+)\)\s*(?=\S)", r"^(\d+)\.\s+(?=\S)"
RECITALS_OPEN, RECITALS_CLOSE, ARTICLES_CLOSE = r"^Whereas\b", r"HA(?:VE|S) ADOPTED", r"^(?:Done at |This (?:Regulation|Decision) shall be binding)"


def resolved_celex(rows: DataFrame) -> DataFrame:
    """(procedure_id, celex_proposal, celex_final, ambiguous) from (procedure_id, celex, role); corrigenda do not count, and two of a role are none."""
    good = rows.where(~F.col("celex").rlike(r"R\(\d+\)$"))
    ids = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("celex")))
    per = good.groupBy("procedure_id").agg(ids("proposal").alias("p"), ids("final").alias("f"))
    only = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    return per.select("procedure_id", only("p").alias("celex_proposal"), only("f").alias("celex_final"), ((F.size("p") > 1) | (F.size("f") > 1)).alias("ambiguous"))


def procedures_for_celex(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(celex, procedure_id) for ``wanted`` (celex); identifiers of another shape are left out."""
    return rows.where(F.col("procedure_id").rlike(r"^\d{4}/\d{4}[A-Z]?\([A-Z]{3}\)$")).join(wanted.distinct(), "celex").select("celex", "procedure_id").distinct()


def act_streams(listing: DataFrame) -> DataFrame:
    """(celex, act, annexes): the first stream that is no annex, and the annexes in order, from (celex, href, name, place)."""
    annex = F.lower("name").contains("annex")
    act = F.min_by(F.when(~annex, F.col("href")), F.when(~annex, F.struct("place", "href")))
    annexes = F.array_sort(F.collect_list(F.when(annex, F.struct("place", "href"))))
    return listing.groupBy("celex").agg(act.alias("act"), F.array_join(F.transform(annexes, lambda x: x["href"]), ",").alias("annexes"))


def blocks(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, n, text, classes, ids) of every paragraph, in order from 0."""
    return pages.select(key, F.posexplode(html_blocks(markup)).alias("n", "b")).select(key, "n", "b.text", "b.classes", "b.ids")


def joined(parts: Column) -> Column:
    """Texts by line; what follows a bare list label stays on its line."""

    def add(acc: Column, text: Column) -> Column:
        glue = F.when(acc["glue"].isNull(), "").otherwise(acc["glue"])
        return F.struct(F.concat(acc["text"], glue, text).alias("text"), F.when(text.rlike(MARKER), " ").otherwise("\n").alias("glue"))

    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("glue"))
    return F.aggregate(parts, start, add, lambda acc: acc["text"])


def document_text(block_rows: DataFrame, key: str) -> DataFrame:
    """(key, text): all blocks of a document."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    return block_rows.groupBy(key).agg(joined(ordered).alias("text"))


def published_on(block_rows: DataFrame, key: str) -> DataFrame:
    """(key, published_on): the date printed in the header; an impossible one is null."""
    dated = block_rows.where(F.array_contains("classes", DATE_CLASS) & F.col("text").rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"))
    first = dated.groupBy(key).agg(F.min_by("text", "n").alias("text"))
    return first.select(key, F.try_to_timestamp("text", F.lit("d.M.yyyy")).cast("date").alias("published_on"))


def eli_section(ids: Column) -> Column:
    """'rct_5'-like id that is outermost among those around a block."""
    return F.get(F.filter(ids, lambda i: i.rlike(ELI)), F.lit(0))


def structured_sections(block_rows: DataFrame, key: str) -> DataFrame:
    """(key, n, text, kind, label) of blocks in marked-up subdivisions, article titles left out."""
    part = eli_section(F.col("ids"))
    kind = F.regexp_extract(part, ELI, 1)
    word = F.when(kind == "rct", "Recital").when(kind == "art", "Article").otherwise("Annex")
    name = F.when(kind == "rct", "recital").when(kind == "art", "article").otherwise("annex")
    rows = block_rows.where(part.isNotNull() & ~F.arrays_overlap("classes", F.array(*map(F.lit, TITLE_CLASSES))))
    return rows.select(key, "n", "text", name.alias("kind"), F.concat(word, F.lit(" "), F.regexp_extract(part, ELI, 2)).alias("label"))


def text_sections(block_rows: DataFrame, key: str) -> DataFrame:
    """The same from headings, where nothing is marked up.

    A fold over a document's blocks keeps the zone (front, recitals, articles, end) and the numbers seen: a
    heading whose number was seen is quoted inside an amending article and stays in its text.
    """
    per = block_rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "text", "classes"))).alias("bs"))
    out = "struct<n:int,text:string,kind:string,label:string>"
    start = F.struct(F.lit("front").alias("zone"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("label"), F.expr("cast(array() as array<string>)").alias("seen"), F.expr(f"cast(array() as array<{out}>)").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        text, zone = b["text"], acc["zone"]
        number, recital = F.regexp_extract(F.split(text, "\n")[0], ARTICLE, 1), F.regexp_extract(text, RECITAL, 1)
        heading = (number != "") & ~F.array_contains(acc["seen"], number)
        opens = ~heading & ~zone.isin("articles", "end") & text.rlike(RECITALS_OPEN)
        closes = ~heading & ~opens & (zone == "recitals") & text.rlike(RECITALS_CLOSE)
        mark = F.concat(F.lit("("), recital, F.lit(")"))
        fresh = ~heading & ~opens & ~closes & (zone == "recitals") & (recital != "") & ~F.array_contains(acc["seen"], mark)
        ends = ~heading & (zone == "articles") & text.rlike(ARTICLES_CLOSE)
        title = (zone == "articles") & F.arrays_overlap(b["classes"], F.array(*map(F.lit, HEADING_CLASSES)))
        kind = F.when(heading, "article").when(fresh, "recital").otherwise(acc["kind"])
        label = F.when(heading, F.concat(F.lit("Article "), number)).when(fresh, F.concat(F.lit("Recital "), recital)).otherwise(acc["label"])
        goes = fresh | (~heading & ~opens & ~closes & ~ends & ~title & zone.isin("recitals", "articles") & acc["label"].isNotNull())
        row = F.struct(b["n"].alias("n"), text.alias("text"), kind.alias("kind"), label.alias("label")).cast(out)
        moved = F.struct(
            F.when(heading, "articles").when(opens, "recitals").when(closes, "front").when(ends, "end").otherwise(zone).alias("zone"), kind.alias("kind"), label.alias("label"),
            F.when(heading, F.concat(acc["seen"], F.array(number))).when(fresh, F.concat(acc["seen"], F.array(mark))).otherwise(acc["seen"]).alias("seen"),
            F.when(goes, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"),
        )
        return F.when(zone == "end", acc).otherwise(moved)

    return per.select(key, F.explode(F.aggregate("bs", start, step, lambda acc: acc["out"])).alias("x")).select(key, "x.*")


def annex_sections(block_rows: DataFrame, key: str) -> DataFrame:
    """Blocks from each annex heading on, the heading included; what stands before the first is dropped."""
    number = F.regexp_extract(F.split("text", "\n")[0], ANNEX, 1)
    heading = F.when(F.split("text", "\n")[0].rlike(ANNEX), F.trim(F.concat(F.lit("Annex "), number)))
    last = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = block_rows.withColumn("label", F.last(heading, ignorenulls=True).over(last)).where("label is not null")
    return rows.select(key, "n", "text", F.lit("annex").alias("kind"), "label")


def provisions(sections: DataFrame, key: str) -> DataFrame:
    """(key, article_id, kind, provision, text): recitals, annexes, articles and their paragraphs.

    A paragraph opens only at the number that is due, so lists inside one do not open another. A label that
    comes again gets a number behind its id.
    """
    per = sections.groupBy(key, "kind", "label").agg(F.min("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("parts"))
    group = "struct<number:int,parts:array<string>>"
    empty = F.expr(f"cast(array() as array<{group}>)")

    def step(acc: Column, text: Column) -> Column:
        number = F.regexp_extract(text, PARAGRAPH, 1).try_cast("int")
        opens = F.coalesce(number == acc["due"], F.lit(False))
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        grown = F.struct(last["number"].alias("number"), F.concat(last["parts"], F.array(text)).alias("parts"))
        fresh = F.struct(F.when(opens, number).alias("number"), F.array(text).alias("parts")).cast(group)
        begins = opens | (F.size(acc["out"]) == 0)
        out = F.when(begins, F.concat(acc["out"], F.array(fresh))).otherwise(F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(grown.cast(group))))
        return F.struct(F.when(opens, acc["due"] + 1).otherwise(acc["due"]).alias("due"), out.alias("out"))

    split = F.aggregate("parts", F.struct(F.lit(1).alias("due"), empty.alias("out")), step, lambda acc: acc["out"])
    whole = F.array(F.struct(F.lit(None).cast("int").alias("number"), F.col("parts")).cast(group))
    rows = per.select(key, "kind", "label", "n", F.posexplode(F.when(F.col("kind") == "article", split).otherwise(whole)).alias("_k", "g"))
    text = joined(F.col("g.parts"))
    text = F.when(F.col("g.number").isNotNull(), F.regexp_replace(text, PARAGRAPH, "")).when(F.col("kind") == "recital", F.regexp_replace(text, RECITAL, "")).otherwise(text)
    name = F.when(F.col("g.number").isNotNull(), F.concat("label", F.lit("("), F.col("g.number").cast("string"), F.lit(")"))).otherwise(F.col("label"))
    kind = F.when(F.col("g.number").isNotNull(), "paragraph").otherwise(F.col("kind"))
    slug = F.lower(T.id_part(F.col("provision")))
    again = F.row_number().over(Window.partitionBy(key, "slug").orderBy("n", "_k"))
    rows = rows.select(key, kind.alias("kind"), name.alias("provision"), text.alias("text"), "n", "_k").withColumn("slug", slug).withColumn("again", again)
    suffix = F.when(F.col("again") > 1, F.concat(F.lit("-"), F.col("again").cast("string"))).otherwise("")
    return rows.select(key, F.concat(F.lit("art:"), T.id_part(F.col(key).cast("string")), F.lit(":"), "slug", suffix).alias("article_id"), "kind", "provision", "text")


def split_act(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """Provisions of acts: by their markup where any is structured, else by their headings."""
    rows = blocks(pages, key, markup)
    marked = rows.where(eli_section(F.col("ids")).isNotNull()).select(key).distinct()
    plain = text_sections(rows.join(marked, key, "left_anti"), key)
    return provisions(structured_sections(rows, key).unionByName(plain), key)


def layer_status(missing: Column, failed: Column, gaps: Column, n: Column) -> Column:
    """struct<status, reason> of a collected layer."""
    reason = F.when(failed.isNotNull(), failed).when(missing.isNotNull(), missing).when(F.size(gaps) > 0, F.array_join(gaps, "; "))
    status = F.when(failed.isNotNull(), "failed").when(missing.isNotNull(), "missing").when(F.size(gaps) > 0, "partial").when(n == 0, "empty").otherwise("complete")
    return F.struct(status.alias("status"), reason.alias("reason"))
