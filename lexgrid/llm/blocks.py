"""Vectors in blocks, query blocks against candidate blocks, and per-query top lists merged as a tree.

Queries fall into groups of at most QUERY_GROUP rows and candidate blocks into shards. Every (group,
shard) cell is one key of an equi-join, so a cell streams its tiles through one task, which keeps only
the running top list of the group's queries. Cells give one list per query; lists merge by eights.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK, QUERY_GROUP, SHARD_ROWS, FAN_IN, LOT = 1024, 4096, 65_536, 65_536, 8, 65_536


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part: no nulls, nothing non-finite; zero vectors only if ``zero``."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    keep = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine
    if not zero:
        keep = keep & F.exists(e, lambda x: x != 0)
    return vectors.where(keep).select(F.col("vec_id").cast("long"), e.alias("embedding"))


class Block(NamedTuple):
    """Vectors of one width by id: ids, how often each row comes, vectors in the narrowest exact type, and what ``code`` makes of them."""

    ids: np.ndarray
    n: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    stats: np.ndarray


_BLOCK = ("ids", "n", "kind", "data", "codes", "stats")
_BLOCK_DDL = "dim int, ids binary, n binary, kind string, data binary, codes binary, stats binary"
Code = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest of five types that holds them all exactly."""
    for kind in ("<i1", "<i2", "<i4", "<f4"):
        with np.errstate(invalid="ignore", over="ignore"):
            y = x.astype(kind)
        if np.array_equal(y.astype(np.float64), x):
            return y
    return x


def no_code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((len(x), 0), np.int8), np.zeros((len(x), 0))


def _pack(batches, rows: int, code: Code):
    """(vec_id, embedding, n) -> blocks of one width, sorted by id; vectors are coded here, once."""
    wait: dict[int, list] = {}

    def block(dim, parts):
        ids, n, data = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(ids, kind="stable")
        x = narrow(data[order])
        codes, stats = code(data[order])
        return dim, ids[order].tobytes(), n[order].tobytes(), x.dtype.str, x.tobytes(), codes.tobytes(), stats.tobytes()

    def out(found):
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([b[i] for b in found], t) for i, t in enumerate(kinds)], ["dim", *_BLOCK])

    for batch in batches:
        ids, lists, many = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        widths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(widths)[:-1]]) if len(widths) else widths
        for dim in np.unique(widths):
            at = np.nonzero(widths == dim)[0]
            data = flat[starts[at][:, None] + np.arange(dim)]
            for i in range(0, len(at), rows):
                wait.setdefault(int(dim), []).append((ids[at[i : i + rows]], many[at[i : i + rows]], data[i : i + rows]))
                if sum(len(p[0]) for p in wait[int(dim)]) >= rows:
                    yield out([block(int(dim), wait.pop(int(dim)))])
    if wait:
        yield out([block(d, p) for d, p in wait.items()])


def _block(batch: pa.RecordBatch, r: int, first: int) -> Block:
    raw = [batch.column(first + i)[r] for i in range(len(_BLOCK))]
    read = lambda i, kind: np.frombuffer(raw[i].as_buffer(), kind)
    ids = read(0, np.int64)
    shape = len(ids), -1 if len(ids) else 0
    wide = lambda x: x.reshape(shape) if x.size else x.reshape(len(ids), 0)
    return Block(ids, read(1, np.int64), wide(read(3, raw[2].as_py())), wide(read(4, np.int8)), wide(read(5, np.float64)))


def _search(batches, tile: Callable, k: int, score):
    """Joined rows (g, h, qn, block of queries, block of candidates) -> query_id, n, qn, at, part, top (negated score and id, best first)."""
    held: dict[int, tuple] = {}
    now = None

    def flush():
        for qn, (q, tops) in held.items():
            sizes = [len(t) for t in tops]
            flat = [x for t in tops for x in t]
            struct = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], score), pa.array([x[1] for x in flat], pa.int64())], ["neg", "vec_id"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), struct)
            m = len(q.ids)
            yield pa.RecordBatch.from_arrays([pa.array(q.ids, pa.int64()), pa.array(q.n, pa.int64()), pa.array(np.full(m, qn), pa.int64()), pa.array(np.arange(m), pa.int32()), pa.array(np.full(m, now[1]), pa.int32()), lists], ["query_id", "n", "qn", "at", "part", "top"])
        held.clear()

    for batch in batches:
        for r in range(batch.num_rows):
            g, h, qn = (batch.column(i)[r].as_py() for i in range(3))
            if (g, h) != now:
                yield from flush()
                now = (g, h)
            if qn not in held:
                q = _block(batch, r, 3)
                held[qn] = q, [[] for _ in q.ids]
            tile(held[qn][0], _block(batch, r, 3 + len(_BLOCK)), held[qn][1], k)
    yield from flush()


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, score, id) triples the k of each row with the largest scores, ties to smaller ids, ordered so."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    first = np.r_[0, np.nonzero(np.diff(rows))[0] + 1] if len(rows) else np.zeros(0, int)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    keep = rank < k
    return rows[keep], scores[keep], ids[keep]


def top_k(vectors: DataFrame, every: int, k: int, tile: Callable, score: str, code: Code = no_code) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, neg. Queries are the rows whose id is divisible by ``every``.

    Queries that are equal in id and vector are searched once and answered as often as they come.
    """
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id", "embedding").agg(F.count("*").alias("n"))
    counts = vectors.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    groups = max(1, math.ceil(counts[1] / QUERY_GROUP))
    shards = max(1, math.ceil(counts[0] / SHARD_ROWS), min(math.ceil(counts[0] / CANDIDATE_BLOCK), math.ceil(2 * vectors.sparkSession.sparkContext.defaultParallelism / groups)))
    named = lambda side: [F.col(c).alias(f"{side}_{c}") for c in _BLOCK]
    q = queries.repartition(max(1, math.ceil(counts[1] / (4 * QUERY_BLOCK))), F.xxhash64("vec_id", "embedding")).mapInArrow(functools.partial(_pack, rows=QUERY_BLOCK, code=code), _BLOCK_DDL)
    q = q.withColumn("qn", F.xxhash64("ids", "data")).select("dim", "qn", F.pmod("qn", F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("h"), *named("q"))
    c = vectors.withColumn("n", F.lit(1).cast("long")).mapInArrow(functools.partial(_pack, rows=CANDIDATE_BLOCK, code=code), _BLOCK_DDL)
    c = c.select("dim", F.pmod(F.xxhash64("ids", "data"), F.lit(shards)).cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), *named("c"))
    pairs = q.join(c, ["g", "h", "dim"]).select("g", "h", "qn", *[f"q_{c}" for c in _BLOCK], *[f"c_{c}" for c in _BLOCK])
    arrow = pa.float64() if score == "double" else pa.int64()
    lists = pairs.mapInArrow(functools.partial(_search, tile=tile, k=k, score=arrow), f"query_id long, n long, qn long, at int, part int, top array<struct<neg {score}, vec_id long>>")
    query = ("query_id", "n", "qn", "at")
    while True:
        lists = lists.groupBy(*query, F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if shards <= FAN_IN:
            break
        shards = math.ceil(shards / FAN_IN)
    lots = lists.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {LOT}"))))
    each = lots.withColumn("copy", F.explode(F.sequence(F.col("lot") * LOT, F.least(F.col("n"), (F.col("lot") + 1) * LOT) - 1)))
    return each.select("query_id", F.posexplode("top").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.neg").alias("neg"))
