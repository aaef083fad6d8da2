"""Streaming queries q51 to q54: streams over the driver's tables, drained into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions.answer import logged
from lexgrid.session import ship
from lexgrid.streaming.streams import drain, event_frames, read_table, sliding_limiter, throttle


def q51_stream_throttle(spark: SparkSession, d: str) -> DataFrame:
    out = drain(throttle(read_table(spark, d, "events"), "user_id", "ts", 5, "1 day"), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "refused")


Q51 = "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, greatest(count(*) - 5, 0) AS refused FROM events GROUP BY ALL"


def q52_stream_sliding_limiter(spark: SparkSession, d: str) -> DataFrame:
    """At most one allowed request of a user in any hour."""
    ship(spark)
    e = read_table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return drain(sliding_limiter(e, "user_id", "at", 1, 3600.0))


Q52 = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, true AS allowed, sec AS held_at FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, e.sec - r.held_at >= 3600, CASE WHEN e.sec - r.held_at >= 3600 THEN e.sec ELSE r.held_at END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, allowed, 1::INTEGER AS held FROM r"""


def q53_stream_event_frames(spark: SparkSession, d: str) -> DataFrame:
    """Turns as frames, cut in two pieces each at an awkward place, and read back."""
    ship(spark)
    c = read_table(spark, d, "conversations")
    eol = F.when(F.col("conv_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    frame = F.concat(F.lit("event: "), F.col("role"), eol, F.lit("data: "), F.to_json(F.struct(F.length("text").alias("data"))), eol, eol)
    cut = (F.col("conv_id") % 11 + 1).cast("int")
    parts = F.array(F.left(frame, cut), F.substr(frame, cut + 1))
    pieces = c.select(F.col("conv_id").alias("connection"), "turn", F.posexplode(parts).alias("k", "piece")).select("connection", (F.col("turn") * 2 + F.col("k")).alias("seq"), "piece")
    out = drain(event_frames(pieces))
    return out.groupBy("connection", "event").agg(F.count("*").alias("frames"), F.sum(F.get_json_object("data", "$.data").cast("long")).alias("chars"))


Q53 = "SELECT conv_id AS connection, role AS event, count(*) AS frames, sum(length(text)) AS chars FROM conversations GROUP BY ALL"


def q54_stream_audit(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers appended to an audit table as they come; answers beyond the logged length are cut, and some are that long here."""
    c = read_table(spark, d, "conversations")
    answer = F.when(F.col("role") != "user", logged(F.repeat("text", 40)))
    return drain(c.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("user_query"), answer.alias("response_text"), (F.col("conv_id") % 3 == 0).alias("was_fallback")))


Q54 = """SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS user_query, CASE WHEN role <> 'user' THEN CASE WHEN length(text) * 40 > 20000 THEN left(repeat(text, 40), 20000) || '... [truncated]' ELSE repeat(text, 40) END END AS response_text,
conv_id % 3 = 0 AS was_fallback FROM conversations"""

QUERIES = [q51_stream_throttle, q52_stream_sliding_limiter, q53_stream_event_frames, q54_stream_audit]
SQL = {"q51_stream_throttle": Q51, "q52_stream_sliding_limiter": Q52, "q53_stream_event_frames": Q53, "q54_stream_audit": Q54}
