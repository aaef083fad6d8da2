"""What the operators of this subpackage share: tables, splits, checkpoints, shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from lexgrid.session import ship

#: Characters that part words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set one only where there is none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints")


#: Tasks for each core of the cluster in a stage that writes files, at most.
TASKS_PER_CORE = 4


def few(df: DataFrame, rows: int | None = None, rows_a_task: int = 50_000) -> DataFrame:
    """The same rows in at most TASKS_PER_CORE partitions a core, and in no more than a known number of rows asks for.

    Partitions beyond that are read one after another by one task: each file costs a task of its own otherwise, and
    on local stores a process of the executor.
    """
    most = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(most if rows is None else max(1, min(most, math.ceil(rows / rows_a_task))))


def cut(df: DataFrame, rows: int | None = None, spread: bool = False) -> DataFrame:
    """The same rows read back from the shared checkpoint folder: lineage ends here and survives lost executors.

    ``spread`` leaves the partitions as they are, where much work goes into each and a lost one should cost no more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if spread else few(df, rows)).checkpoint(eager=True)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder that nobody reads any more, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def row_hash(rows: DataFrame) -> Column:
    """A hash of whole rows; maps, which have none, go in as text."""
    return F.xxhash64(*[F.col(f.name).cast("string") if isinstance(f.dataType, MapType) else F.col(f.name) for f in rows.schema])


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds; null ids have no fold."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string")) % F.lit(folds)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, chars: int) -> DataFrame:
    """At most ``rows`` labelled texts outside the held-out fold, chosen by a hash of the id.

    The bound is a parameter of the classifier that is fitted on it: only texts of at most ``chars``
    characters are taken, so the driver receives rows * chars characters at the very most.
    The ids are chosen first, so that documents meet a side of at most ``rows`` rows.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of("doc_id", folds) != held_out))
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(order, "doc_id").limit(rows)
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= chars))
    return texts.join(F.broadcast(ids), "doc_id").orderBy(order, "doc_id", F.xxhash64("text")).limit(rows)


def _in_slices(score: Callable, texts: pa.Array, rows: int = 512) -> np.ndarray:
    """Scores of a column, with few texts at a time as Python strings."""
    return np.concatenate([np.zeros(0), *(score(texts.slice(at, rows).to_pylist()) for at in range(0, len(texts), rows))])


def score_of(text: Column, make: Callable) -> Column:
    """A score for every text; ``make`` gives each task a function from texts to scores. Only the texts go to Python."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = make()
        for texts in batches:
            yield pa.array(_in_slices(found, texts), pa.float64())

    return score(text.cast("string"))


# --- word shingles -------------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgotten all at once when there are many."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text.

    A-Z is lower-cased; words are runs without ASCII white space (bytes.split() parts at exactly those
    six bytes). Fewer words than ``width`` make one shingle; a null text or one without words makes none.
    """
    if not text:
        return np.empty(0, np.uint64)
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    k = min(n, width)
    acc = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        acc = mix(acc * _MULT + h[j : n - k + 1 + j])
    return np.unique(acc)
