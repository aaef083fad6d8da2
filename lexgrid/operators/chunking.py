"""Clauses to chunk rows: pieces, their header, metadata and index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.functions.text import MAX_CHUNK, clause_pieces

_BASE = ("province", "municipality", "bylaw", "section", "section_title", "page", "url", "document_version", "language")


def _both(a: str, b: str) -> Column:
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")


def chunk_content(part: Column, of: Column, body: Column) -> Column:
    """A chunk as it is searched and read: where it comes from, its section, its text."""
    head = F.concat(F.lit("[Province: "), F.col("province_code"), F.lit("] [Municipality: "), F.col("municipality_name"), F.lit("] [Bylaw: "), F.col("bylaw_name"), F.lit("]"))
    section = F.when(_both("part_number", "part_title"), F.concat(F.lit(" [Part "), "part_number", F.lit(": "), "part_title", F.lit("]"))).otherwise("")
    parent = F.when(_both("parent_number", "parent_title"), F.concat(F.lit(" ["), "parent_number", F.lit(" "), "parent_title", F.lit("]"))).otherwise("")
    title = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" "), "section_title")).otherwise("")
    marker = F.when(of > 1, F.concat(F.lit(" (part "), part.cast("string"), F.lit(" of "), of.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(head, section, parent, F.lit("\nSection "), F.col("section_number"), title, marker, F.lit(":\n"), body)


def metadata(part: Column, of: Column) -> Column:
    """JSON of nine keys that are always there, null or not, and of those that a clause has."""
    values = ("province_code", "municipality_id", "bylaw_name", "section_number", "section_title", "page_number", "source_url", "document_version", "language")
    value = lambda c: F.coalesce(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}).substr(6, 1 << 30), F.lit("null}"))
    pair = lambda name, c: F.concat(F.lit(f'"{name}":'), F.regexp_replace(value(c), r"\}$", ""))
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    base = [pair(k, F.col(c)) for k, c in zip(_BASE, values, strict=True)]
    optional = [
        F.when(has("page_label"), pair("page_label", F.col("page_label"))),
        F.when(has("part_number"), F.concat(pair("part", F.col("part_number")), F.lit(","), pair("part_title", F.col("part_title")))),
        F.when(has("parent_number"), F.concat(pair("parent_section", F.col("parent_number")), F.lit(","), pair("parent_title", F.col("parent_title")))),
        F.when(F.coalesce(F.size("amendments"), F.lit(0)) > 0, pair("amendments", F.col("amendments"))),
        F.when(of > 1, F.concat(pair("chunk_part", part), F.lit(","), pair("chunk_parts", of))),
    ]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*base, *optional)), ","), F.lit("}"))


def chunk_clauses(clauses: DataFrame, limit: int = MAX_CHUNK, document: tuple[str, ...] = ("municipality_id", "bylaw_name", "language"), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Clauses with the facts of their document -> a row for every chunk, all columns kept but the text.

    clauses: the columns of ``document`` and ``order``, province_code, municipality_name, section_number, section_title,
    text, page_number, page_label, part_number, part_title, parent_number, parent_title, amendments, source_url,
    document_version. ``chunk_index`` counts a section's chunks through its document, as numbers may come again;
    ``part`` counts from 1. Blank texts give no chunk.
    """
    pieces = clauses.withColumn("pieces", clause_pieces(F.col("text"), limit)).drop("text")
    each = pieces.select("*", F.size("pieces").alias("parts"), F.posexplode("pieces").alias("part", "body")).drop("pieces").withColumn("part", F.col("part") + 1)
    index = F.row_number().over(Window.partitionBy(*document, "section_number").orderBy(*order, "part")) - 1
    made = each.withColumns({"chunk_content": chunk_content(F.col("part"), F.col("parts"), F.col("body")), "metadata": metadata(F.col("part"), F.col("parts"))}).drop("body")
    return made.withColumn("chunk_index", index)


def chunk_counts(chunks: DataFrame, document: tuple[str, ...] = ("municipality_id", "bylaw_name", "language")) -> DataFrame:
    """sections, chunks and split clauses of every document: distinct numbers, not clauses."""
    return chunks.groupBy(*document).agg(F.count_distinct("section_number").alias("sections"), F.count("*").alias("chunks"), F.count_if((F.col("parts") > 1) & (F.col("part") == 1)).alias("split_clauses"))
