"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Each source's documents stand in shuffled order, their words dealt into blocks of equal length. A source
needs as many slots as its target has blocks. Slot times are van der Corput points: point i of 2**m
falls on cell bit_reverse(i) of a line on which the sources lie with lengths equal to their slots, so each
source gets exactly its slots, spread evenly over time. Slots are ranked per source in time order; rank r
takes block r modulo the source's blocks, and the last slot ends where the target is reached. What is taken of a
document, and when, are sums over the slots that hold it; the mixed table comes in the order of the slots.

Nothing runs over one source in one task: running sums are taken within cells of a hash of the document,
and within stretches of time, and then over the sums of those.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrid.llm.common import TASKS_PER_CORE, cut, row_hash, table, word_count

WEIGHTS, SHARE, MOST, BLOCK, STRETCH = (5, 2, 1), 1.5, 2, 512, 1 << 16
#: A source's documents are dealt into at least 16 ** 3 cells, and into more from so many rows a cell on.
CELL_ROWS = 1 << 16
#: Slots of a partition of the mixed table, at most: some 50 MB of text.
STRETCH_SLOTS = 1 << 14


def _digest() -> Column:
    """The shuffled order of a source: a digest of the id and of the text, so that repeated ids are spread too."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|mix|"), text).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> source, sid, source_size, target; one row per source, in one task as their order is needed.

    Sources by code point, null last, take the weights in turn. Targets are the water level times the
    weight: sources are filled in order of the level at which they reach ``most`` times their size, and
    all that are not reached share what remains by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0))
    weights_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighted.withColumn("level", left / weights_left).withColumn("full", F.lit(most) * F.col("source_size") <= F.col("level") * F.col("weight"))
    at = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "sid", "level"))).over(all_rows)
    return level.withColumn("at", at).select("source", "sid", "source_size", F.when(F.col("full"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(F.col("at.level") * F.col("weight")).alias("target"))


def _reversed_bits(x: Column, bits: int) -> Column:
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long")), bits - 1 - b))
    return out


def schedule(spark: SparkSession, plan: DataFrame, slots: int) -> DataFrame:
    """plan (sid, first_cell, needed, ...) -> sid, time, rank: every slot of the mix, in van der Corput time."""
    bits = max(1, (slots - 1).bit_length())
    stretch = F.col("cell").bitwiseAND(F.lit(-STRETCH))
    points = spark.range(1 << bits).select(F.col("id").alias("time"), _reversed_bits(F.col("id"), bits).alias("cell")).where(F.col("cell") < slots).withColumn("stretch", stretch)
    lines = plan.where("needed > 0").select("sid", "first_cell", (F.col("first_cell") + F.col("needed")).alias("end_cell"))
    lines = lines.withColumn("stretch", F.explode(F.sequence(F.col("first_cell").bitwiseAND(F.lit(-STRETCH)), (F.col("end_cell") - 1).bitwiseAND(F.lit(-STRETCH)), F.lit(STRETCH).cast("long"))))
    placed = points.join(lines, "stretch").where("cell >= first_cell AND cell < end_cell").select("sid", "time", F.floor(F.col("time") / STRETCH).alias("part"))
    counts = placed.groupBy("sid", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked"))
    within = Window.partitionBy("sid", "part").orderBy("time")
    return placed.withColumn("at", F.row_number().over(within) - 1).join(counts, ["sid", "part"]).select("sid", "time", (F.col("ranked") + F.col("at")).alias("rank"))


class _Mix(NamedTuple):
    """placed: distinct rows with their number n and first word's place ``start`` in the line of their source;
    dealt: a row for every copy in the mix, whole or cut, with its words and the slot in which it begins."""

    placed: DataFrame
    dealt: DataFrame
    slots: int


def _each(rows: DataFrame) -> DataFrame:
    """A row for each of ``n`` equal ones, in lists of a bounded size however many there are."""
    lots = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {STRETCH}"))))
    copies = lots.withColumn("copy", F.explode(F.sequence(F.col("lot") * STRETCH, F.least(F.col("n"), (F.col("lot") + 1) * STRETCH) - 1)))
    return copies.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("lot", "copy")


def _mix(documents: DataFrame, weights: tuple[int, ...], share: float, most: int, block: int) -> _Mix:
    spark = documents.sparkSession
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), _digest().alias("mix_key"), row_hash(documents).alias("row_key"))
    rows = cut(rows.groupBy("source", "mix_key", "row_key", "doc_id", "size").agg(F.count("*").alias("n")))
    digits = max(3, math.ceil(math.log(max(1, rows.count()) / CELL_ROWS, 16)))
    rows = rows.withColumn("cell", F.substring("mix_key", 1, digits))
    cells = rows.groupBy("source", "cell").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    plan = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    blocks, whole = F.ceil(F.col("source_size") / block), F.floor(F.col("target") + 0.5).cast("long")
    plan = plan.withColumns({"whole": whole, "blocks": blocks}).withColumn("passes", F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(F.lit(0)))
    plan = plan.withColumn("over", F.col("whole") - F.col("passes") * F.col("source_size")).withColumn("needed", F.col("passes") * F.col("blocks") + F.ceil(F.col("over") / block))
    plan = cut(plan.withColumn("first_cell", F.sum("needed").over(Window.orderBy("sid")) - F.col("needed")))
    slots = plan.agg(F.coalesce(F.sum("needed"), F.lit(0))).first()[0]

    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("source", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    named = plan.select(F.col("source").alias("p_source"), "sid", "source_size", "target")
    starts = starts.join(named, F.col("source").eqNullSafe(F.col("p_source"))).select(F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), "before", "sid", "source_size", "target")
    within = Window.partitionBy("source", "cell").orderBy("mix_key", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0)))
    placed = cut(placed.join(starts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell"))).select("doc_id", "source", "mix_key", "row_key", "size", "n", "source_size", "target", "sid", (F.col("before") + F.col("at")).alias("start")))

    line = schedule(spark, plan, slots).join(plan.select("sid", "blocks", "passes", "over"), "sid")
    turn = F.expr("rank div blocks")
    line = line.select("sid", "time", turn.alias("turn"), F.expr("rank % blocks").alias("block"), F.when(turn == F.col("passes"), F.col("over")).otherwise(F.lit((1 << 63) - 1)).alias("until"))
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    pieces = _each(placed.where("size > 0")).select("sid", "start", "size", "mix_key", "row_key", F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    taken = pieces.join(line, ["sid", "block"]).withColumn("words", F.least(high, F.col("until")) - low).where("words > 0")
    dealt = taken.groupBy("sid", "start", "turn").agg(F.sum("words").alias("words"), F.min("time").alias("time"), F.max("size").alias("size"), F.max("mix_key").alias("mix_key"), F.max("row_key").alias("row_key"))
    return _Mix(placed, dealt, slots)


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """documents (doc_id, text, source, ...) -> doc_id, source, size, source_size, target, taken, first_time; one row per document.

    ``taken`` words of a document are in the mix, in the slots that its source has in the schedule;
    ``first_time`` is the time of the first of them, null where nothing is taken. A source's taken words are its
    target rounded to a whole number. Null and empty texts have size 0 and are taken 0 times; the null source is
    a source. Rows without or with repeated doc_ids are dealt like others; equal rows may stand for each other.
    Columns other than the three only tell rows apart. An empty table gives an empty result.
    """
    placed, dealt, _ = _mix(documents, weights, share, most, block)
    sums = dealt.groupBy("sid", "start").agg(F.sum("words").alias("taken"), F.min("time").alias("first_time"))
    some = _each(placed.where("size > 0")).join(sums, ["sid", "start"], "left")
    none = _each(placed.where("size = 0")).withColumns({"taken": F.lit(0).cast("long"), "first_time": F.lit(None).cast("long")})
    return some.unionByName(none).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_time")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table with the words that the mix takes of it, and when it comes first; as ``mix``."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The documents as the mix takes them, all columns kept: a row per copy, in the order of the schedule.

    A copy comes with the slot that holds its first word; partitions are stretches of time, sorted within, so
    that every prefix of the table has about the shares of the whole. The text of a document cut by the target
    ends at its last taken word, white space before it as it was; an n_chars column is measured anew. Null and
    empty texts are not in the mix. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    placed, dealt, slots = _mix(documents, weights, share, most, block)
    rows = documents.withColumns({"_mix_key": _digest(), "_row_key": row_hash(documents)})
    repeated = placed.where("n > 1").select(F.col("mix_key").alias("_mix_key"), F.col("row_key").alias("_row_key"))
    if not repeated.isEmpty():  # one row stands for those that are equal
        key = ["_mix_key", "_row_key"]
        one = rows.join(repeated, key, "left_semi").groupBy(*key).agg(*[F.first(c).alias(c) for c in documents.columns])
        rows = rows.join(repeated, key, "left_anti").unionByName(one)
    copies = dealt.select(F.col("mix_key").alias("_mix_key"), F.col("row_key").alias("_row_key"), F.col("time").alias("_time"), F.when(F.col("words") < F.col("size"), F.col("words")).alias("_words"))
    parts = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, math.ceil(slots / STRETCH_SLOTS))
    stretch = F.least(F.floor(F.col("_time") * parts / F.lit(1 << max(1, (slots - 1).bit_length()))), F.lit(parts - 1)).cast("int")
    out = rows.join(copies, ["_mix_key", "_row_key"]).repartitionById(parts, stretch).sortWithinPartitions("_time", "_mix_key", "_row_key")
    words = F.split(F.col("text").cast("string"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.col("text").cast("string").rlike(r"^[\x20\x09-\x0D]").cast("int")
    begun = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int") + lead), ""), r"[\x20\x09-\x0D]+$", "")
    out = out.withColumn("text", F.when(F.col("_words").isNull(), F.col("text")).otherwise(begun))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("_words").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(documents.schema["n_chars"].dataType)))
    return out.select(*documents.columns)


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix|' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS lvl,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS pos
  FROM w WINDOW p AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 2 * source_size <= lvl * weight AS filled FROM l),
t AS (
  SELECT source, source_size, CASE WHEN filled THEN CAST(2 * source_size AS DOUBLE) ELSE (SELECT arg_min(lvl, pos) FROM f WHERE NOT filled) * weight END AS target FROM f),
p AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, CAST(floor(target + 0.5) AS BIGINT) AS whole, CAST(ceil(source_size / 512) AS BIGINT) AS blocks FROM t),
n AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE (whole // source_size) * blocks + CAST(ceil((whole % source_size) / 512) AS BIGINT) END AS needed FROM p),
c AS (SELECT *, CAST(sum(needed) OVER (ORDER BY sid) - needed AS BIGINT) AS first_cell FROM n),
b AS (SELECT greatest(1, CASE WHEN sum(needed) <= 1 THEN 0 ELSE length(ltrim(bin(CAST(sum(needed) - 1 AS BIGINT)), '0')) END) AS bits FROM n),
v AS (
  SELECT i AS time, list_sum([((i >> CAST(k AS INTEGER)) & 1) << CAST(bits - 1 - k AS INTEGER) FOR k IN range(bits)]) AS cell
  FROM (SELECT bits, unnest(range(CAST(1 AS BIGINT) << CAST(bits AS INTEGER))) AS i FROM b)),
z AS (SELECT sid, time, row_number() OVER (PARTITION BY sid ORDER BY time) - 1 AS rank FROM v JOIN c ON cell >= first_cell AND cell < first_cell + needed),
o AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.whole, c.sid,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
q AS (SELECT *, CAST(CASE WHEN size = 0 THEN 0 ELSE (whole // source_size) * size + greatest(0, least(size, whole % source_size - start)) END AS BIGINT) AS taken FROM o)
SELECT doc_id, size, source_size, target, taken, CAST(z.time AS BIGINT) AS first_time
FROM q LEFT JOIN z ON q.taken > 0 AND z.sid = q.sid AND z.rank = q.start // 512
"""
