"""The registry of municipalities and their sources: reading it, its rules, and the ledgers that record what was done."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.operators.checks import violations
from lexgrid.operators.store import upsert

SOURCE = "struct<language:string,bylaw_name:string,source_url:string,source_type:string,document_version:string>"
ENTRY = f"id string, province_code string, name string, languages array<string>, is_active boolean, status string, source_bylaw_name string, source_url string, bylaw_last_verified_at string, verified_by string, interleaved_bilingual boolean, numbering string, sources array<{SOURCE}>"
#: Provinces and territories, languages, kinds of sources, states of an entry.
PROVINCES = ("AB", "BC", "MB", "NB", "NL", "NS", "ON", "PE", "QC", "SK", "NT", "NU", "YT")
LANGUAGES, TYPES = ("en", "fr"), ("pdf", "html")
STATES = ("ready", "ready_high_staleness_risk", "blocked_needs_decision", "blocked_no_citable_source")
#: What is shown of a municipality's verification.
VERIFIED, UNVERIFIED = "Bylaw text last verified ", "Bylaw text has not yet been verified against this municipality's current consolidation — it may be out of date."


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The entries of registry files (JSON with a list ``municipalities``)."""
    return spark.read.schema(f"municipalities array<struct<{', '.join(c.replace(' ', ': ', 1) for c in ENTRY.split(', '))}>>").option("multiLine", True).json(path).select(F.inline("municipalities"))


def registry_errors(entries: DataFrame) -> DataFrame:
    """(id, error) for every rule that an entry or one of its sources breaks; an empty registry is an error without id.

    Rules: ids come once and begin with the province's code; provinces, languages, states and kinds of sources are known
    ones; languages are named; active entries have sources and are not blocked; sources are https and in a language of
    their entry; a verification date says who verified. Null lists are empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    listed = entries.withColumns({"languages": F.coalesce("languages", F.array().cast("array<string>")), "sources": F.coalesce("sources", F.array().cast(f"array<{SOURCE}>")), "active": F.coalesce("is_active", F.lit(False))})
    any_source = lambda bad: F.exists("sources", bad)
    rules = {
        "province_code is no province": ~text("province_code").isin(*PROVINCES),
        "id does not begin with its province": (text("province_code") != "") & ~F.coalesce("id", F.lit("")).startswith(F.concat(F.lower("province_code"), F.lit("_"))),
        "languages are empty": F.size("languages") == 0,
        "languages beyond those stored": F.size(F.array_except("languages", F.array(*map(F.lit, LANGUAGES)))) > 0,
        "status is unknown": ~text("status").isin(*STATES),
        "active without sources": F.col("active") & (F.size("sources") == 0),
        "active although blocked": F.col("active") & text("status").startswith("blocked"),
        "source_url is not https": any_source(lambda s: ~F.coalesce(s["source_url"], F.lit("")).startswith("https://")),
        "source language is not declared": any_source(lambda s: ~F.coalesce(F.array_contains("languages", s["language"]), F.lit(False))),
        "source_type is neither pdf nor html": any_source(lambda s: ~F.coalesce(s["source_type"], F.lit("")).isin(*TYPES)),
        "verified without verified_by": (text("bylaw_last_verified_at") != "") & (text("verified_by") == ""),
    }
    repeated = entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id comes more than once").alias("error"))
    empty = entries.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("id"), F.lit("no municipalities").alias("error"))
    return reduce(DataFrame.unionByName, [violations(listed, "id", rules), repeated, empty])


def sync_registry(current: DataFrame, entries: DataFrame) -> DataFrame:
    """The municipalities table after a run: entries replace rows of their id; the date of verification stays what people made it."""
    new = entries.select("id", "province_code", "name", "source_bylaw_name", F.coalesce("source_url", F.lit("")).alias("source_url"), F.coalesce("languages", F.array(F.lit("en"))).alias("languages"), F.coalesce("is_active", F.lit(False)).alias("is_active"), F.lit(None).cast("date").alias("bylaw_last_verified_at"))
    return upsert(current, new, ["id"], keep=("bylaw_last_verified_at",))


LEDGER_KEY = ["municipality_id", "language", "bylaw_name"]


def record_fetch(ledger: DataFrame, fetched: DataFrame) -> DataFrame:
    """The sources table after successful runs: fetched (key, source_url, source_type, content_hash, last_fetched_at, document_version).

    A document version that is null or empty leaves the recorded one; the date of verification is never touched.
    """
    new = fetched.withColumn("last_verified_at", F.lit(None).cast("date"))
    return upsert(ledger, new, LEDGER_KEY, keep=("last_verified_at",), fill=("document_version",))


def mark_verified(municipalities: DataFrame, ledger: DataFrame, tenant: str, on: str, language: str | None = None, bylaw_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables after a person confirmed the text: the tenant's date, and that of its sources, of one language or bylaw if named."""
    date = F.lit(on).cast("date")
    hit = F.col("municipality_id") == tenant
    hit = hit & (F.col("language") == language) if language else hit
    hit = hit & (F.col("bylaw_name") == bylaw_name) if bylaw_name else hit
    dated = lambda when, c: F.when(when, date).otherwise(F.col(c))
    return municipalities.withColumn("bylaw_last_verified_at", dated(F.col("id") == tenant, "bylaw_last_verified_at")), ledger.withColumn("last_verified_at", dated(hit, "last_verified_at"))


def oldest_source(ledger: DataFrame) -> DataFrame:
    """municipality_id and the oldest verification among its sources, null while one of them has none."""
    oldest = F.when(F.count("*") == F.count("last_verified_at"), F.min("last_verified_at"))
    return ledger.groupBy("municipality_id").agg(oldest.alias("bylaw_last_verified_at"))


def verification_label(verified_on: Column) -> Column:
    return F.when(verified_on.isNotNull(), F.concat(F.lit(VERIFIED), verified_on.cast("string"))).otherwise(F.lit(UNVERIFIED))


def choices(entries: DataFrame, province: str | None = None) -> DataFrame:
    """Active entries by name, of one province if named, as they are offered for choice."""
    some = entries.where(F.coalesce("is_active", F.lit(False)))
    return (some if province is None else some.where(F.col("province_code") == province)).orderBy("name", "id")


def gate(found: Column, active: Column) -> Column:
    """404 for an unknown tenant, 409 for one that is not active, else 200."""
    return F.when(~F.coalesce(found, F.lit(False)), 404).when(~F.coalesce(active, F.lit(False)), 409).otherwise(200)


def request_errors(requests: DataFrame, key: str = "request") -> DataFrame:
    """(request, error) for requests that are refused: query of 3 to 1,000 characters, a tenant of 1 to 64, known province and language, session of at most 64; ends are stripped first."""
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    rules = {
        "query": ~F.length(bare("query")).between(3, 1000),
        "municipality_id": ~F.length(bare("municipality_id")).between(1, 64),
        "province_code": ~bare("province_code").isin(*PROVINCES),
        "language": ~F.coalesce(F.nullif(bare("language"), F.lit("")), F.lit("en")).isin(*LANGUAGES),
        "session_id": F.length(bare("session_id")) > 64,
    }
    return violations(requests, key, rules)
