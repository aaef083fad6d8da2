"""Queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexgrid.llm.ann_int8 import op2_ann
from lexgrid.llm.best_fit_packing import op9_packing
from lexgrid.llm.exact_topk import op6_exact_topk
from lexgrid.llm.licence_scan import op10_licence_scan
from lexgrid.llm.line_crf import op4_quality
from lexgrid.llm.minhash_dedup import op3_near_dedup
from lexgrid.llm.mixing import OP5_SQL, op5_mixing
from lexgrid.llm.ring_sharding import op7_sharding
from lexgrid.llm.toxicity import op1_toxicity
from lexgrid.llm.warc_derivatives import OP8_SQL, op8_warc_derivatives

#: Every pair of a query and a candidate, ranked: fine on the tables of the SQL check, as they are.
_RANKED = """
WITH v AS ({vectors}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {score} AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
OP6_SQL = _RANKED.format(vectors="SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL", score="CAST(list_dot_product(q.e, c.e) AS BIGINT)")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_ann, op3_near_dedup, op4_quality, op5_mixing, op6_exact_topk, op7_sharding, op8_warc_derivatives, op9_packing, op10_licence_scan)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": OP5_SQL, "op6_exact_topk": OP6_SQL, "op8_warc_derivatives": OP8_SQL}
