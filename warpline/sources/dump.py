"""Parliament dumps: one JSON record per line of a compressed array; catalog, amendments, members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from warpline.functions import text as T
from warpline.session import spread

PROCEDURE = r"^\d{4}/\d{4}[A-Z]?\([A-Z]{3}\)$"
# Stage names, event types and committee types of the dump.
ENDED = ("procedure lapsed or withdrawn", "procedure rejected", "procedure lapsed", "procedure withdrawn")
PROPOSAL_EVENTS = ("Legislative proposal published", "Initial legislative proposal published")
FINAL_EVENT, END_EVENT = "Final act published in Official Journal", "End of procedure in Parliament"
LEAD_TYPES = ("Responsible Committee", "Joint Responsible Committee")

#: Fields that a source writes as a string or a list of them arrive as strings of JSON.
DOSSIER = """procedure struct<reference:string,title:string,stage_reached:string,subject:string,final:struct<url:string>>,
events array<struct<date:string,type:string,docs:array<struct<title:string>>>>,
docs array<struct<date:string>>,
committees array<struct<type:string,responsible:string,committee:string,rapporteur:array<struct<name:string>>>>"""
AMENDMENT = "reference string, id string, seq string, date string, committee string, location string, `old` string, `new` string, meps array<bigint>, authors string, justification string, orig_lang string"
MEMBER = "UserID bigint, Name struct<full:string>, Constituencies array<struct<country:string,start:string,end:string>>, Groups array<struct<groupid:string,start:string,end:string>>"


def dump_lines(spark: SparkSession, path: str, containing: str | None = None) -> DataFrame:
    """(value) of every record line, the array's brackets and commas taken off.

    ``containing`` is looked for in the raw line, before anything is parsed. Compressed files are read as they are;
    splittable ones and many files in parallel. Lines of fewer files than cores are dealt out before they are parsed.
    """
    lines = spread(spark.read.text(path) if isinstance(path, str) else path)
    body = F.regexp_replace(F.trim("value"), r"^[\[,]|\]$", "")
    lines = lines.where(F.col("value").contains(containing)) if containing else lines
    return lines.select(F.trim(body).alias("value")).where("value <> ''")


def read_dump(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed records; a line that is no JSON object gives null fields."""
    return lines.select(F.from_json("value", schema).alias("r"), "value").select("r.*", "value")


def latest_date(lines: DataFrame) -> DataFrame:
    """One row (latest): the last day named in any "date" field, without parsing a record."""
    days = F.regexp_extract_all("value", F.lit(r'"date": ?"(\d{4}-\d{2}-\d{2})'), F.lit(1))
    return lines.select(F.array_max(days).alias("d")).agg(F.max("d").alias("latest"))


def strings(value: Column) -> Column:
    """A field written as one string or a list of them, as a list; anything else is empty."""
    many = F.from_json(value, S.ArrayType(S.StringType()))
    return F.when(value.isNull(), F.expr("cast(array() as array<string>)")).when(F.ltrim(value).startswith("["), F.coalesce(F.filter(many, lambda x: x.isNotNull()), F.expr("cast(array() as array<string>)"))).otherwise(F.array(value))


def text_or_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", F.trim(value))


def day(value: Column) -> Column:
    """The calendar day of an ISO time; null if it is none."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def status(stage: Column) -> Column:
    s = F.lower(stage)
    return F.when(s.startswith("procedure completed"), "completed").when(s.isin(*ENDED), "withdrawn").when(s.startswith("awaiting") | s.startswith("preparatory"), "ongoing").otherwise("unknown")


def subjects(value: Column) -> Column:
    """Code and label of a map; older records hold finished strings."""
    as_map = F.from_json(value, S.MapType(S.StringType(), S.StringType()))
    pairs = F.transform(F.map_entries(as_map), lambda e: F.trim(F.concat_ws(" ", e["key"], e["value"])))
    return F.when(F.ltrim(value).startswith("{"), pairs).otherwise(strings(value))


def lead(committees: Column) -> Column:
    """struct<committee, rapporteurs> of the first responsible committee; joint ones are joined by a slash."""
    first = F.get(F.filter(committees, lambda c: c["type"].isin(*LEAD_TYPES) | (c["responsible"] == "true")), F.lit(0))
    names = F.filter(F.transform(first["rapporteur"], lambda p: text_or_null(p["name"])), lambda n: n.isNotNull())
    return F.struct(text_or_null(F.array_join(strings(first["committee"]), "/")).alias("committee"), names.alias("rapporteurs"))


def skip_reason(records: DataFrame) -> Column:
    reference = F.col("procedure.reference")
    return F.when(F.col("procedure").isNull(), "no_procedure").when(reference.isNull() | ~reference.rlike(PROCEDURE), "reference_not_a_procedure")


def catalog(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped): one entry per dossier that is a procedure; the others counted by reason."""
    marked = records.withColumn("reason", skip_reason(records))
    none = F.expr("cast(array() as array<date>)")
    titles = F.flatten(F.transform("events", lambda e: F.coalesce(F.transform(e["docs"], lambda d: d["title"]), F.expr("cast(array() as array<string>)"))))
    steps = F.transform(F.coalesce("events", F.expr("array()")), lambda e: F.struct(day(e["date"]).alias("day"), e["type"].alias("type")))
    # What is used more than once is a column first, so that it is computed once.
    good = marked.where("reason is null").withColumns({"_steps": steps, "_lead": lead(F.col("committees")), "_titles": titles, "_state": status(text_or_null(F.col("procedure.stage_reached")))})
    of = lambda *types: F.transform(F.filter("_steps", lambda e: e["type"].isin(*types) & e["day"].isNotNull()), lambda e: e["day"])
    good = good.withColumns({"_published": of(FINAL_EVENT), "_ended": of(END_EVENT), "_coms": F.filter("_titles", lambda t: F.trim(t).rlike(rf"^{T.COM}$"))})
    coms = F.array_distinct(F.transform("_coms", lambda t: T.com_reference(t)))
    done, state = F.when(F.size("_published") > 0, F.col("_published")).otherwise(F.col("_ended")), F.col("_state")
    days = F.concat(F.transform("_steps", lambda e: e["day"]), F.coalesce(F.transform("docs", lambda d: day(d["date"])), none))
    celex = F.regexp_extract(F.col("procedure.final.url"), r"(?i)CELEX[:%3A]*(\d{5}[A-Z]{1,2}\d{4})", 1)
    head = F.col("_lead")
    entries = good.select(
        F.col("procedure.reference").alias("procedure_id"), F.coalesce(text_or_null(F.col("procedure.title")), F.lit("")).alias("title"), state.alias("status"),
        text_or_null(F.col("procedure.stage_reached")).alias("stage_reached"), subjects(F.col("procedure.subject")).alias("subjects"), F.when(celex != "", celex).alias("celex_final"),
        F.coalesce(coms, F.expr("cast(array() as array<string>)")).alias("com_references"), head["committee"].alias("lead_committee"), head["rapporteurs"].alias("rapporteurs"),
        F.array_min(of(*PROPOSAL_EVENTS)).alias("proposed_on"), F.when(state == "completed", F.array_max(done)).alias("completed_on"), F.array_max(days).alias("last_activity_on"),
    )
    return entries, marked.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _wording(value: Column) -> Column:
    return F.when(value.isNotNull(), F.array_join(strings(value), "\n"))


def author_names(value: Column) -> Column:
    """The names of a comma-separated line, white space closed up."""
    parts = F.flatten(F.transform(strings(value), lambda line: F.split(line, ",")))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def location(value: Column) -> Column:
    """Targets joined by semicolons; the parts of one by dashes."""
    nested = F.from_json(value, S.ArrayType(S.StringType()))
    one = lambda x: F.when(F.ltrim(x).startswith("["), F.array_join(F.transform(strings(x), lambda p: F.trim(p)), " - ")).otherwise(F.trim(x))
    return text_or_null(F.array_join(F.filter(F.transform(nested, one), lambda x: x != ""), "; "))


def amendments(records: DataFrame, procedure_id: str, stage: str) -> tuple[DataFrame, DataFrame]:
    """(amendments, skipped) of one procedure; of records with one identifier the first stays.

    ``records`` has the column ``place``, the order of the input.
    """
    own = records.where(F.col("reference") == procedure_id)
    committee = text_or_null(F.array_join(strings(F.col("committee")), "/"))
    label = F.lit("PLENARY") if stage == "plenary" else T.id_part(F.coalesce(committee, F.lit("UNKNOWN")))
    source, old, new = text_or_null(F.col("id")), _wording(F.col("old")), _wording(F.col("new"))
    key = F.concat_ws(":", F.lit("am"), T.id_part(F.lit(procedure_id)), label, T.id_part(source))
    blank = (F.trim(F.coalesce(old, F.lit(""))) == "") & (F.trim(F.coalesce(new, F.lit(""))) == "")
    first = F.row_number().over(Window.partitionBy("amendment_id").orderBy("place"))
    rows = own.withColumn("amendment_id", key)
    reason = F.when(source.isNull(), "no_id").when(blank, "no_text").when(T.id_part(source).isNull(), "invalid")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").withColumn("n", first)
    rows = rows.where("reason is not null").unionByName(good.withColumn("reason", F.when(F.col("n") > 1, "duplicate_id")).drop("n"))
    seq = F.when(F.col("seq").rlike(r"^[0-9]+$"), F.col("seq").try_cast("int"))
    kept = rows.where("reason is null").select(
        "amendment_id", F.lit(procedure_id).alias("procedure_id"), F.lit(stage).alias("stage"), committee.alias("committee"), seq.alias("number"),
        F.transform(F.coalesce("meps", F.expr("cast(array() as array<bigint>)")), lambda m: T.mep_actor_id(m)).alias("author_ids"), author_names(F.col("authors")).alias("author_names"),
        day(F.col("date")).alias("tabled_on"), location(F.col("location")).alias("target_provision"), old.alias("old_text"), F.coalesce(new, F.lit("")).alias("new_text"),
        text_or_null(F.col("justification")).alias("justification"), F.lower(text_or_null(F.col("orig_lang"))).alias("language"),
    )
    return kept, rows.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def members(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(member_id, actor_id, name, country, latest_group, spells) of the members in ``wanted`` (member_id)."""
    from warpline.operators.entities import latest_value

    spells = F.transform(F.filter("Groups", lambda g: text_or_null(g["groupid"]).isNotNull()), lambda g: F.struct(text_or_null(g["groupid"]).alias("group"), day(g["start"]).alias("start"), day(g["end"]).alias("end")))
    rows = records.join(wanted.distinct(), F.col("UserID") == F.col("member_id"), "left_semi").where(text_or_null(F.col("Name.full")).isNotNull())
    return rows.select(
        F.col("UserID").alias("member_id"), T.mep_actor_id(F.col("UserID")).alias("actor_id"), text_or_null(F.col("Name.full")).alias("name"),
        latest_value(F.col("Constituencies"), "country").alias("country"), latest_value(F.col("Groups"), "groupid").alias("latest_group"), spells.alias("spells"),
    )


def provenance(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(document_id, path, bytes, sha256) of source files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(T.document_id(kind, F.regexp_replace(name, r"\.json(\.zst|\.lz)?$", "")).alias("document_id"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
