"""The register of organisations: XML entries, declared costs, actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.functions import text as T

ENTRY, EURO = "interestRepresentative", "€"
SCHEMA = """identificationCode string, name struct<originalName:string,nameInLatinAlphabet:string>, acronym string, registrationCategory string, webSiteURL string,
headOffice struct<country:string>, structure struct<isMemberOf:string,organisationMembers:string>,
financialData struct<closedYear:struct<costs:struct<_currency:string,absoluteCost:string,range:struct<min:string,max:string>>,totalBudget:struct<absoluteCost:string>>>"""


def legal_xml(text: Column) -> Column:
    """Character references that XML 1.0 forbids become a space."""
    return F.regexp_replace(text, r"&#(?:x(?:0*(?:[0-8bBcCeEfF]|1[0-9a-fA-F]))|0*(?:[0-8]|1[1245-9]|2[0-9]|3[01]));", " ")


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Raw entries; the file is split by its entries, and columns are read by name."""
    return spark.read.format("xml").option("rowTag", ENTRY).schema(SCHEMA).load(path)


def squeezed(value: Column) -> Column:
    """White space closed up; blank is null."""
    text = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(text != "", text)


def amount(value: Column) -> Column:
    return F.when(value.rlike(r"^\d+(\.\d+)?$"), value.try_cast("double"))


def declared_cost(costs: Column) -> Column:
    """struct<eur, raw>: the exact sum, or the middle of the band from its floor (else 0) to its ceiling.

    A band without a ceiling has no middle, and no other currency is turned into euro; the declaration stays.
    """
    exact, low, high = squeezed(costs["absoluteCost"]), squeezed(costs["range"]["min"]), squeezed(costs["range"]["max"])
    some = exact.isNotNull() | low.isNotNull() | high.isNotNull()
    part = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"{name}="), v))
    raw = F.when(some, F.concat_ws(" ", part("exact", exact), part("min", low), part("max", high), F.concat(F.lit("currency="), F.coalesce(costs["_currency"], F.lit("")))))
    middle = (F.coalesce(amount(low), F.lit(0.0)) + amount(high)) / 2
    return F.struct(F.when(costs["_currency"] == EURO, F.coalesce(amount(exact), middle)).alias("eur"), raw.alias("raw"))


def country_code(value: Column, countries: DataFrame | None = None) -> Column:
    """The key to compare countries by: upper case, white space closed up. ``with_country`` turns names into codes."""
    return F.upper(squeezed(value))


def with_country(rows: DataFrame, column: str, countries: DataFrame) -> DataFrame:
    """Adds country_code from ``countries`` (name, code): names and codes are both accepted, others are null."""
    known = countries.select(F.upper("name").alias("_k"), "code").unionByName(countries.select(F.col("code").alias("_k"), "code")).distinct()
    return rows.join(known, country_code(F.col(column)) == F.col("_k"), "left").withColumnRenamed("code", "country_code").drop("_k")


def entries(raw: DataFrame, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped): usable entries, and those without a well-formed id or a name."""
    cost = declared_cost(F.col("financialData.closedYear.costs"))
    rows = raw.select(
        squeezed(F.col("identificationCode")).alias("register_id"), squeezed(F.col("name.originalName")).alias("name"), squeezed(F.col("name.nameInLatinAlphabet")).alias("latin_name"),
        squeezed(F.col("acronym")).alias("acronym"), squeezed(F.col("registrationCategory")).alias("category"), squeezed(F.col("headOffice.country")).alias("country"), cost["eur"].alias("declared_cost_eur"),
        cost["raw"].alias("declared_cost_raw"), amount(squeezed(F.col("financialData.closedYear.totalBudget.absoluteCost"))).alias("total_budget_eur"), squeezed(F.col("webSiteURL")).alias("website"),
    )
    usable = T.usable_register_id(F.col("register_id")).isNotNull() & F.col("name").isNotNull()
    return with_country(rows.where(usable), "country", countries), rows.where(~F.coalesce(usable, F.lit(False))).select("register_id", "name")


def check_entries(rows: DataFrame) -> DataFrame:
    """An empty register is a wrong file: its query fails."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no entry in the register")).cast("bigint")).alias("n"))


def to_actors(rows: DataFrame) -> DataFrame:
    """(actor_id, kind, name, register_id, category, country, aliases, resolution, score): certain by definition."""
    names = F.array_sort(F.array_distinct(F.filter(F.array("name", "latin_name", "acronym"), lambda n: n.isNotNull())))
    return rows.select(
        T.register_actor_id(F.col("register_id")).alias("actor_id"), F.lit("organisation").alias("kind"), "name", "register_id", "category",
        F.coalesce("country_code", "country").alias("country"), names.alias("aliases"), F.lit("register_id").alias("resolution"), F.lit(1.0).alias("score"),
    )
