"""The log of answered questions: what a row holds, appending it, and how many answers were fallbacks."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.functions.answer import logged


def audit_rows(answers: DataFrame, *more: str) -> DataFrame:
    """answers (municipality_id, user_query, chunk_ids, response_text, was_fallback, language, ...) -> rows of the log, with ``more`` columns kept.

    Long answers are cut, ids become strings, and an answer is a fallback if nothing was retrieved, unless it says
    itself. Sessions are not among the columns.
    """
    ids = F.coalesce(F.transform("chunk_ids", lambda i: i.cast("string")), F.array().cast("array<string>"))
    return answers.select(*more, "municipality_id", "user_query", ids.alias("retrieved_chunk_ids"), logged(F.col("response_text")).alias("response_text"), F.coalesce("was_fallback", F.size(ids) == 0).alias("was_fallback"), "language")


def record(rows: DataFrame, path: str) -> bool:
    """Append to the log; whether that worked. The answer is out by then, so a failure is told and not raised."""
    try:
        rows.write.mode("append").parquet(path)
    except (PySparkException, Py4JJavaError) as e:
        logging.getLogger(__name__).error("audit rows were not written to %s: %s", path, e)
        return False
    return True


def fallback_rate(log: DataFrame) -> DataFrame:
    """fallbacks, total in one pass."""
    return log.agg(F.count_if("was_fallback").alias("fallbacks"), F.count("*").alias("total"))
