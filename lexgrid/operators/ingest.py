"""Runs over a registry of sources: which are taken, how each ends, and the summary; one row a source, failures isolated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.operators.store import decision

#: Outcomes that fail a run, the least number of clauses of a healthy parse, the summary's width.
FAILED, MORE_THAN, WIDTH = ("error", "source_gone", "not_a_document"), 20, 92
ROW, HEAD = "%-20s%-6s%-16s%8s%8s%8s%6s", ("municipality", "lang", "status", "clauses", "chunks", "upsert", "del")


def selected(registry: DataFrame, municipality: str | None = None, include_inactive: bool = False, language: str | None = None) -> DataFrame:
    """The sources of a run: id, language, bylaw_name, source_url, also_languages, status.

    registry: id, is_active, status, interleaved, sources (array of struct language, bylaw_name, source_url),
    and as a fallback source_url, languages, source_bylaw_name. Without a municipality only active entries
    count. A named one that is inactive is skipped unless asked for. Languages that share a document are one
    source, named by the first, unless the document holds them side by side. ``status`` is null for sources
    to fetch, else skipped_inactive or no_source.
    """
    entries = registry.where(F.col("is_active")) if municipality is None else registry.where(F.col("id") == municipality)
    own = F.struct(F.coalesce(F.get("languages", F.lit(0)), F.lit("en")).alias("language"), F.col("source_bylaw_name").alias("bylaw_name"), "source_url")
    none = F.array().cast("array<struct<language:string,bylaw_name:string,source_url:string>>")
    listed = F.when(F.coalesce(F.size("sources"), F.lit(0)) > 0, F.col("sources")).when(F.coalesce("source_url", F.lit("")) != "", F.array(own)).otherwise(none)
    skipped = ~F.coalesce("is_active", F.lit(False)) & F.lit(not include_inactive)
    rows = entries.select("id", F.coalesce("interleaved", F.lit(False)).alias("interleaved"), skipped.alias("skipped"), listed.alias("listed"))
    status = F.when(F.col("skipped"), "skipped_inactive").when(F.size("listed") == 0, "no_source")
    each = rows.select("id", "interleaved", status.alias("status"), F.posexplode_outer(F.when(~F.col("skipped"), F.col("listed"))).alias("n", "s"))
    apart = F.when(F.col("interleaved") | F.col("s").isNull(), F.col("n"))
    same = each.groupBy("id", "status", F.col("s.source_url").alias("source_url"), apart.alias("apart")).agg(F.sort_array(F.collect_list(F.struct("n", "s.language", "s.bylaw_name"))).alias("all"))
    out = same.select("id", F.get("all", F.lit(0))["language"].alias("language"), F.get("all", F.lit(0))["bylaw_name"].alias("bylaw_name"), "source_url", F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda x: x["language"]).alias("also_languages"), "status")
    return out if language is None else out.where(F.col("status").isNotNull() | (F.col("language") == language))


def is_document(content: Column, expect: Column) -> Column:
    """The signature that a declared type demands; other types have none."""
    return (expect != "pdf") | (F.substring(content, 1, 4) == F.lit(b"%PDF"))


def outcome(http_status: Column, error: Column, document: Column, previous: Column, current: Column, forced: Column, clauses: Column, oversized: Column, dry_run: Column, pending: Column, embedded: Column) -> Column:
    """How a source ends, in the order in which a run would find out; null counts are 0, null flags false."""
    number = lambda c: F.coalesce(c, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    changed = decision(previous, current, yes(forced))
    unhealthy = (number(oversized) > 0) | (number(clauses) <= MORE_THAN)
    steps = [
        (http_status.isin(404, 410), F.lit("source_gone")),
        (error.isNotNull() | ~yes(http_status.between(200, 299)), F.lit("error")),
        (~yes(document), F.lit("not_a_document")),
        (changed == "unchanged", F.lit("unchanged")),
        (number(clauses) == 0, F.lit("no_clauses")),
        (unhealthy & ~yes(forced), F.lit("unhealthy_parse")),
        (yes(dry_run), F.lit("dry_run")),
        (number(embedded) < number(pending), F.lit("quota_exhausted")),
    ]
    return F.coalesce(*[F.when(when, then) for when, then in steps], changed)


def failures(outcomes: DataFrame) -> DataFrame:
    """sources, failed, exit_code of a run: 1 where any source failed."""
    bad = F.count_if(F.col("status").isin(*FAILED))
    return outcomes.agg(F.count("*").alias("sources"), bad.alias("failed"), (bad > 0).cast("int").alias("exit_code"))


def summary(outcomes: DataFrame) -> DataFrame:
    """The report of a run as lines (block, id, language, status, detail, k, line), in the order of these columns.

    outcomes: id, language, status, clauses, chunks, upserted, deleted, detail. Block 0 is the head, block 1 has a line
    or two for every source, block 2 the totals. Lines carry the order instead of a number, so none needs a task of all.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    row = F.format_string(ROW, text("id"), text("language"), text("status"), count("clauses"), count("chunks"), count("upserted"), count("deleted"))
    lines = F.when(F.coalesce("detail", F.lit("")) != "", F.array(row, F.concat(F.lit("    -> "), F.col("detail")))).otherwise(F.array(row))
    named = ("id", "language", "status", "detail")
    body = outcomes.select(F.lit(1).alias("block"), *[F.col(c).cast("string").alias(c) for c in named], F.posexplode(lines).alias("k", "line"))
    framed = lambda df, block, lines: df.select(F.lit(block).alias("block"), *[F.lit(None).cast("string").alias(c) for c in named], F.posexplode(lines).alias("k", "line"))
    bar, rule = "=" * WIDTH, "-" * WIDTH
    total = F.format_string("%d source(s): %d chunks written, %d unchanged, %d failed", F.count("*"), F.coalesce(F.sum("upserted"), F.lit(0)), F.count_if(F.col("status") == "unchanged"), F.count_if(F.col("status").isin(*FAILED)))
    last = framed(outcomes.agg(total.alias("t")), 2, F.array(F.lit(bar), "t"))
    top = framed(outcomes.sparkSession.range(1), 0, F.array(*[F.lit(x) for x in ("", bar, "INGESTION SUMMARY", bar, ROW % HEAD, rule)]))
    return top.unionByName(body).unionByName(last)
