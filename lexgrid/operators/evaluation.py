"""Golden questions: suites read from JSON, answers held against what was expected of them, scores of suites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many fused results count as retrieved, and the share of questions that a suite must pass.
TOP_K, THRESHOLD = 8, 0.85
SUITE = "municipality_id string, language string, bylaw_name string, notes array<string>, questions array<struct<id:string,question:string,expect_sections:array<string>,expect_text:array<string>,match:string,expect_fallback:boolean,why:string>>"


def read_suites(spark: SparkSession, path: str, tenant: str | None = None) -> DataFrame:
    """suite (the file's name), municipality_id, language and the fields of its questions; in the order of names when sorted by suite.

    The language is en where a suite names none, and every expected section must be retrieved where it names no match.
    """
    read = spark.read.schema(SUITE).option("multiLine", True).json(path).withColumn("suite", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    some = read if tenant is None else read.where(F.col("municipality_id") == tenant)
    each = some.select("suite", "municipality_id", F.coalesce("language", F.lit("en")).alias("language"), F.explode("questions").alias("x"))
    return each.select("suite", "municipality_id", "language", "x.id", "x.question", "x.expect_sections", "x.expect_text", F.coalesce("x.match", F.lit("all")).alias("match"), F.coalesce("x.expect_fallback", F.lit(False)).alias("expect_fallback"), "x.why")


def evaluate(questions: DataFrame, retrieved: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """questions (q, suite, expect_sections, expect_text, match, expect_fallback) x retrieved (q, fused_rank, section_number, chunk_content[, degraded])
    -> q, suite, passed, retrieved (the first five sections), failures, degraded.

    A question that expects a fallback must retrieve nothing. Otherwise all of its sections must be among the first
    ``top_k``, or any of them where match is any, and each text must stand in what was retrieved. Null lists expect nothing.
    """
    degraded = F.col("degraded") if "degraded" in retrieved.columns else F.lit(False)
    top = retrieved.where(F.col("fused_rank") <= top_k).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("fused_rank", "section_number", "chunk_content"))).alias("found"), F.bool_or(degraded).alias("degraded"))
    joined = questions.join(top, "q", "left")
    nothing = F.array().cast("array<string>")
    sections = F.coalesce(F.transform("found", lambda x: x["section_number"]), nothing)
    corpus = F.coalesce(F.array_join(F.transform("found", lambda x: x["chunk_content"]), "\n"), F.lit(""))
    named = joined.withColumns({"sections": sections, "corpus": corpus, "wanted": F.coalesce("expect_sections", nothing), "texts": F.coalesce("expect_text", nothing)})
    missing = F.filter("wanted", lambda s: ~F.array_contains("sections", s))
    none_of = (F.size("wanted") > 0) & (F.size(missing) == F.size("wanted"))
    lacking = F.when(F.col("match") == "any", F.when(none_of, F.concat(F.lit("none of "), F.array_join("wanted", ", ")))).otherwise(F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))))
    unsaid = F.transform(F.filter("texts", lambda t: ~F.contains("corpus", t)), lambda t: F.concat(F.lit("text not found: "), t))
    failures = F.when(F.col("expect_fallback"), F.array_compact(F.array(F.when(F.size("sections") > 0, F.lit("expected no retrieval"))))).otherwise(F.concat(F.array_compact(F.array(lacking)), unsaid))
    judged = named.withColumn("failures", failures)
    return judged.select("q", "suite", (F.size("failures") == 0).alias("passed"), F.slice("sections", 1, 5).alias("retrieved"), "failures", F.coalesce("degraded", F.lit(False)).alias("degraded"))


def suite_scores(results: DataFrame, threshold: float = THRESHOLD, strict: bool = False) -> DataFrame:
    """suite, questions, passed, score, degraded, good: a suite is good at the threshold, and where ``strict`` if nothing was degraded."""
    scored = results.groupBy("suite").agg(F.count("*").alias("questions"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("double")).alias("score"), F.bool_or("degraded").alias("degraded"))
    good = F.col("score") >= threshold
    return scored.withColumn("good", good & ~F.col("degraded") if strict else good)
