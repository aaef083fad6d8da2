"""From raw documents to packed sequences: reject toxic and bad documents, thin out copies, mix sources, pack.

Every stage takes documents (doc_id, text, lang, source, n_chars and whatever else) and works on all rows that the
stage before kept. Null and empty texts are scored like texts without words, are never copies, are not taken by the
mix, and rows without doc_id are judged by their texts alone. Repeated rows are one after the near-dedup stage. An
empty table gives an empty one, with the columns that the stage has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexgrid.llm.best_fit_packing import pack, tokenizer_path
from lexgrid.llm.common import ensure_checkpoint_dir, few, forget, table
from lexgrid.llm.line_crf import without_bad
from lexgrid.llm.minhash_dedup import keep_one
from lexgrid.llm.mixing import mixed_documents
from lexgrid.llm.toxicity import without_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a classifier fitted on the labelled ones among them."""
    return few(without_toxic(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are good, by a field fitted on the labelled ones among them."""
    return few(without_bad(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of every group of near copies at Jaccard 0.80 or more."""
    return few(keep_one(docs, percent=80))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; the last of a source may end early."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return few(pack(docs, tokenizer_path()))


STAGES = [("toxicity", toxicity_stage), ("quality classifier", quality_stage), ("near dedup", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Models are fitted and texts tokenised on the way, which SQL cannot express; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet in the shared folder and read again; what was read is deleted."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            forget(spark, f"{folder}/{k - 1}")
    return docs
