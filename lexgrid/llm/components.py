"""Connected components of a graph held as an edge table, by alternating large and small stars.

Every round is two grouped minimums, each joined back on the same key, and ends in a checkpoint, so no
component is ever held by one task. Rounds are logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): for every u, hang its larger (large) or all smaller neighbours on the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = both.join(least, "u")
    out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hung.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): every node that has an edge, with the least node of its component.

    Nulls and self-loops are ignored; an empty edge table gives an empty result. Repeated edges count once.
    """
    now = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    before, rows = None, now.count()
    while True:
        now = cut(_star(_star(now, True), False), rows)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, rows = state, state[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
