"""Keyed writes of a chunk store as whole-set transforms: upserts, orphans, resumption, change decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions.lexemes import text_vector
from lexgrid.functions.text import trigrams


def upsert(current: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace current ones of equal key.

    Columns in ``keep`` hold on to the current value where there is one; those in ``fill`` take the new value unless
    it is null or empty, and then keep the current one.
    """
    replaced = new
    if keep or fill:
        old = current.select(*key, *[F.col(c).alias(f"_{c}") for c in (*keep, *fill)])
        merged = {c: F.coalesce(f"_{c}", c) for c in keep} | {c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_{c}")) for c in fill}
        replaced = new.join(old, key, "left").withColumns(merged).drop(*[f"_{c}" for c in (*keep, *fill)])
    return current.join(new.select(*key), key, "left_anti").unionByName(replaced)


def replace_document(current: DataFrame, new: DataFrame, key: list[str], document: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The store after a document was read anew: its rows upserted, then those of it that no longer come removed.

    A document is named by the columns ``document``; without new rows nothing is removed, as nothing was read.
    """
    after = upsert(current, new, key, keep)
    gone = orphans(current.join(new.select(*document).distinct(), document, "left_semi"), new, key)
    return after.join(gone.select(*key), key, "left_anti")


def insert_missing(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Seeds: rows whose key is there already change nothing."""
    return current.unionByName(new.join(current.select(*key), key, "left_anti"))


def orphans(current: DataFrame, keep: DataFrame, key: list[str]) -> DataFrame:
    return current.join(keep.select(*key).distinct(), key, "left_anti")


def pending(new: DataFrame, stored: DataFrame, key: list[str], fingerprint: str) -> DataFrame:
    """Rows whose fingerprint is not the stored one; keys that are not stored count as different."""
    old = stored.select(*key, F.col(fingerprint).alias("_stored"))
    return new.join(old, key, "left").where(~F.col("_stored").eqNullSafe(F.col(fingerprint))).drop("_stored")


def decision(previous: Column, current: Column, forced: Column) -> Column:
    return F.when(forced, "forced").when(previous.isNull(), "new").when(previous != current, "content_changed").otherwise("unchanged")


def indexed(chunks: DataFrame) -> DataFrame:
    """Chunks with what searches read of their texts, to be written with them: content_tsv, the places of lexemes, and content_grams.

    Columns of these names are made anew. Null texts have no trigrams, and the lexemes of their titles.
    """
    title = F.col("section_title") if "section_title" in chunks.columns else F.lit(None).cast("string")
    return chunks.withColumns({"content_tsv": text_vector(title, F.col("chunk_content"), F.col("language")), "content_grams": trigrams(F.col("chunk_content"))})


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that come more than once: none may, before a write."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def replace_table(spark: SparkSession, rows: DataFrame, root: str, key: list[str], folders: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> str:
    """Write the final set beside the old one, check it, and give the new folder, for the caller to record last.

    ``folders`` part the files by columns that every search names, ``order`` sorts within them, so that scans
    skip by folder and by row group. Ranges of folders, order and key are dealt evenly, however much of the
    rows one folder has. Read the folder with the schema of the rows, as folder names carry no types.
    """
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    by = list(dict.fromkeys([*folders, *order, *key]))
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by) if folders or order else rows
    laid.write.partitionBy(*folders).parquet(path)
    if not repeated_keys(spark.read.schema(rows.schema).parquet(path), key).isEmpty():
        raise ValueError(f"{path}: keys repeat")
    return path


def without_vectors(chunks: DataFrame, sources: DataFrame, element: str = "float") -> tuple[DataFrame, DataFrame]:
    """A change of vector width: vectors of chunks and content hashes of sources are cleared, so that all is embedded anew."""
    empty = F.lit(None).cast(f"array<{element}>")
    return chunks.withColumn("embedding", empty), sources.withColumn("content_hash", F.lit(None).cast("string"))
