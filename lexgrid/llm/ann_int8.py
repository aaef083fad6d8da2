"""Approximate nearest neighbours as a block matrix join on int8 codes, with error bounds.

A vector x is coded once, where blocks are made, as s * c with int8 c in -127..127; blocks carry the codes beside the
vectors in their own narrowest type. For coded q, c the product differs from the
true one by at most |q| * |c - c'| + |q - q'| * |c'|, so a tile of code products brackets every score.
Pairs whose upper bound reaches the k-th lower bound survive, are recomputed from the original vectors in
double precision and merged into per-query heaps. The bounds lose nothing: recall is 1.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.blocks import Block, best, top_k, usable
from lexgrid.llm.common import table

SLOP = 1e-9
PAIRS_AT_ONCE = 200_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows -> int8 codes, and per row its scale, |x|, |x - x'| and |x'|. Norms that overflow are infinite: such bounds exclude nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max(axis=1, initial=0) / 127
        scale[scale == 0] = 1
        codes = np.rint(x / scale[:, None])
        back = codes * scale[:, None]
        return codes.astype(np.int8), np.column_stack([scale, np.linalg.norm(x, axis=1), np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)])


def _tile(q: Block, c: Block, tops: list, k: int) -> None:
    (qs, qn, qe, _), (cs, _, ce, cn) = q.stats.T, c.stats.T
    with np.errstate(over="ignore", invalid="ignore"):
        near = (q.codes.astype(np.float32) @ c.codes.astype(np.float32).T).astype(np.float64)
        near = np.nan_to_num(near * qs[:, None] * cs[None, :])
        bound = (qn[:, None] * ce[None, :] + qe[:, None] * cn[None, :]) * (1 + SLOP) + np.abs(near) * SLOP
        bound = np.where(np.isfinite(bound), bound, np.inf)
        low, high = near - bound, near + bound
    own = np.searchsorted(c.ids, q.ids), np.searchsorted(c.ids, q.ids, "right")
    for i in np.nonzero(own[0] < own[1])[0]:
        low[i, own[0][i] : own[1][i]] = high[i, own[0][i] : own[1][i]] = -np.inf
    floor = -np.partition(-low, k - 1, axis=1)[:, k - 1] if low.shape[1] > k else np.full(len(q.ids), -np.inf)
    held = np.array([-t[k - 1][0] if len(t) == k else -np.inf for t in tops])
    rows, cols = np.nonzero((high >= np.maximum(floor, held)[:, None]) & (high > -np.inf))
    exact = lambda r, o: np.einsum("ij,ij->i", q.x[r].astype(np.float64), c.x[o].astype(np.float64))
    with np.errstate(over="ignore", invalid="ignore"):
        scores = np.concatenate([np.empty(0)] + [exact(rows[i : i + PAIRS_AT_ONCE], cols[i : i + PAIRS_AT_ONCE]) for i in range(0, len(rows), PAIRS_AT_ONCE)])
    rows, scores, ids = best(rows, scores, c.ids[cols], k)
    ends = np.searchsorted(rows, np.arange(len(q.ids) + 1))
    for i in range(len(q.ids)):
        if ends[i] < ends[i + 1]:
            new = zip((-scores[ends[i] : ends[i + 1]]).tolist(), ids[ends[i] : ends[i + 1]].tolist(), strict=True)
            tops[i] = list(itertools.islice(heapq.merge(tops[i], new), k))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: the k largest inner products of each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but those of the
    query's own vec_id. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without vec_id, take no part. Vectors of different widths do not meet. Every query row is answered, those
    that repeat an id by their own vectors; repeated candidates are separate hits. Ties go to smaller
    vec_ids. An empty table gives an empty result; other columns are not read.
    """
    return top_k(usable(vectors, zero=False), every, k, _tile, "double", quantise).withColumn("score", -F.col("neg")).drop("neg")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20; as ``nearest``."""
    return nearest(table(spark, sf_dir, "embeddings"))
