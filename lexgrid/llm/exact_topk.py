"""Exact top-k by integer inner product: tiled matrix products, partial selection per tile, tree merging.

Components become floor(64 * x). Products run in float32 where every partial sum stays below 2**24, in
float64 below 2**53, and in whole numbers of any size beyond, so scores are exact; a score that a long
cannot hold is given as the nearest long. Components whose multiple is beyond the largest double count as that.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.blocks import Block, best, top_k, usable
from lexgrid.llm.common import table

_MOST, _LARGEST = (1 << 63) - 1, float(np.finfo(np.float64).max)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows: floats while these are exact, else int64."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most < 1 << 24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if most < 1 << 53:
        return q.astype(np.float64) @ c.astype(np.float64).T
    big = [np.array([[int(min(max(x, -_LARGEST), _LARGEST)) for x in row] for row in m.tolist()], object) for m in (q, c)]
    return np.clip(big[0] @ big[1].T, -_MOST, _MOST).astype(np.int64)


def _tile(q: Block, c: Block, tops: list, k: int) -> None:
    s = products(q.x, c.x)
    lowest = -np.inf if s.dtype.kind == "f" else -_MOST - 1
    own = np.searchsorted(c.ids, q.ids), np.searchsorted(c.ids, q.ids, "right")
    for i in np.nonzero(own[0] < own[1])[0]:
        s[i, own[0][i] : own[1][i]] = lowest
    at = s.shape[1] - k
    floor = np.partition(s, at, axis=1)[:, at] if at > 0 else np.full(len(q.ids), lowest, s.dtype)
    held = np.array([-t[k - 1][0] if len(t) == k else lowest for t in tops]).astype(s.dtype)
    rows, cols = np.nonzero((s >= np.maximum(floor, held)[:, None]) & (s > lowest))
    rows, scores, ids = best(rows, s[rows, cols].astype(np.int64), c.ids[cols], k)
    ends = np.searchsorted(rows, np.arange(len(q.ids) + 1))
    for i in range(len(q.ids)):
        if ends[i] < ends[i + 1]:
            new = list(zip((-scores[ends[i] : ends[i + 1]]).tolist(), ids[ends[i] : ends[i + 1]].tolist(), strict=True))
            tops[i] = sorted(tops[i] + new)[:k]


def highest(vectors: DataFrame, every: int = 20, k: int = 20, steps: int = 64) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: the k highest integer inner products.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but those of the
    query's own vec_id. Vectors that are null, empty or hold null or non-finite components, and rows without
    vec_id, take no part; zero vectors do. Vectors of different widths do not meet. Every query row is
    answered, those that repeat an id by their own vectors; repeated candidates are separate hits. Ties go to
    smaller vec_ids. An empty table gives an empty result; other columns are not read.
    """
    whole = usable(vectors, zero=True).withColumn("embedding", F.transform("embedding", lambda x: _floor(x * steps)))
    return top_k(whole, every, k, _tile, "long").withColumn("score", -F.col("neg")).drop("neg")


def _floor(x):
    """floor as a double: Spark's floor gives a long, which ends at 2**63; doubles from 2**52 on are whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer products of every vector whose id is divisible by 20; as ``highest``."""
    return highest(table(spark, sf_dir, "embeddings"))
