"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Rows fall on a ring of 2**16 places by a hash of their key; every shard owns virtual nodes there. A row
goes to the first virtual node clockwise whose shard still has room. Rooms add up to exactly the number
of rows and differ by at most one, so counts do (law ``rows``).

Which rows overflow depends only on counts per place, so the walk round the ring is made once over these
65,536 counts, a fixed number at any size of the data, and gives ranges of ranks per place. Rows then find
their range by a broadcast join with at most places + shards ranges.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrid.llm.common import cut, table

PLACES, NODES = 1 << 16, 128
#: Ranks of equal rows that are made at once, so that many copies take no more memory than few.
TOGETHER = 1 << 13


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise; a shard's nodes don't depend on the number of shards."""
    return sorted((xxhash.xxh64_intdigest(f"{s}/{v}") % PLACES, s) for s in range(shards) for v in range(nodes))


def walk(counts: dict[int, int], shards: int, nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """Counts per place -> (place, first rank, end rank, shard, first slot), filling shards clockwise up to their room."""
    at = ring(shards, nodes)
    places = [p for p, _ in at]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    taken, out = [0] * shards, []
    after = list(range(len(at)))  # the next virtual node from here on whose shard may have room

    def open_node(i: int) -> int:
        path = []
        while True:
            i = after[i]
            if taken[at[i][1]] < room[at[i][1]]:
                break
            path.append(i)
            i = after[i] = (i + 1) % len(at)
        for j in path:
            after[j] = i
        return i

    for place in sorted(counts):
        rank, left = 0, counts[place]
        i = bisect.bisect_left(places, place) % len(at)
        while left:
            i = open_node(i)
            s = at[i][1]
            n = min(left, room[s] - taken[s])
            out.append((place, rank, rank + n, s, taken[s]))
            taken[s], rank, left = taken[s] + n, rank + n, left - n
    return out


def shard(documents: DataFrame, shards: int = 40, nodes: int = NODES) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, size, text_crc32, shard, slot.

    The key of a row is its doc_id with the checksum of its text, so that rows which repeat or lack a
    doc_id spread over the ring. Equal rows may stand for each other and are counted before they move;
    where they are many, their ranks are made in blocks of TOGETHER.
    Null texts weigh 16 bytes and have no checksum; empty ones have checksum 0. Columns other than doc_id
    and text are not read. An empty table gives an empty result.
    """
    text = F.col("text").cast("string").cast("binary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text_crc32"))
    keys = cut(rows.groupBy("doc_id", "size", "text_crc32", "digest", "hash").agg(F.count("*").alias("copies")).withColumn("place", F.pmod("hash", F.lit(PLACES)).cast("int")))
    counts = {r[0]: r[1] for r in keys.groupBy("place").agg(F.sum("copies")).collect()}
    ranges = documents.sparkSession.createDataFrame(walk(counts, shards, nodes), "place int, low long, high long, shard int, slot0 long")
    before = Window.partitionBy("place").orderBy("hash", "doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("first", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    last = F.col("first") + F.col("copies") - 1
    blocks = ranked.select("*", F.explode(F.sequence(F.col("first"), last, F.lit(TOGETHER).cast("long"))).alias("from"), last.alias("last"))
    each = blocks.withColumn("rank", F.explode(F.sequence("from", F.least(F.col("from") + (TOGETHER - 1), F.col("last")))))
    found = each.join(F.broadcast(ranges), "place").where("rank >= low AND rank < high")
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("low")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
