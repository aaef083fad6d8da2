"""Reads of the driver's tables, and their view as the chunks of a clause store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """documents as chunk rows: id, municipality_id, language, section_number, page_number, chunk_content[, embedding]."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    section = F.concat((n % 12 + 1).cast("string"), F.lit("."), (n % 40).cast("string"), F.when(n % 3 == 0, F.concat(F.lit("("), (n % 5).cast("string"), F.lit(")"))).otherwise(""))
    out = d.select(n.alias("id"), F.col("source").alias("municipality_id"), F.col("lang").alias("language"), section.alias("section_number"), (n % 300 + 1).cast("int").alias("page_number"), F.col("text").alias("chunk_content"))
    return out.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left") if vectors else out


CHUNKS_SQL = """chunks AS (
  SELECT doc_id AS id, source AS municipality_id, lang AS language,
         (doc_id % 12 + 1) || '.' || (doc_id % 40) || CASE WHEN doc_id % 3 = 0 THEN '(' || (doc_id % 5) || ')' ELSE '' END AS section_number,
         CAST(doc_id % 300 + 1 AS INTEGER) AS page_number, text AS chunk_content, embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""
