"""The pipeline, stage by stage."""

from collections import Counter, defaultdict

import corpus_pipeline
from lexgrid.llm.best_fit_packing import tokenizer_path
from lexgrid.llm.common import TASKS_PER_CORE, table
from lexgrid.llm.line_crf import quality
from lexgrid.llm.minhash_dedup import near_duplicates
from lexgrid.llm.mixing import mix
from lexgrid.llm.toxicity import toxicity
from test_documents import brute_components, check_sequences, odd_documents

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, labels = docs.columns, table(spark, SF, "labels")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    counts = {name: df.count() for name, df in seen.items()}
    assert counts["quality classifier"] < counts["toxicity"] < 1000
    clean = labels.where("quality = 1 AND toxic = 0")
    assert seen["quality classifier"].join(clean, "doc_id").count() >= 0.97 * clean.count()
    one = near_duplicates(seen["quality classifier"], percent=80).where("kept").count()
    assert counts["near dedup"] == one
    pieces = defaultdict(int)
    for r in seen["packing"].collect():
        pieces[r["sequence_id"]] += r["length"]
    assert max(pieces.values()) <= 2048


def test_stages_against_brute_force(spark, tmp_path):
    """Every decision of every stage, from its own input: scores, components pair by pair, the mix's words, the tokenizer's ids."""
    from tokenizers import Tokenizer

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    stages = dict(corpus_pipeline.STAGES)
    size = lambda t: len((t or "").split())

    def through(name, docs):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    clean = through("toxicity", docs)
    assert ids(clean) == sorted(r["doc_id"] for r in toxicity(docs, docs, labels).where("predicted = 0").collect())
    good = through("quality classifier", clean)
    assert ids(good) == sorted(r["doc_id"] for r in quality(clean, clean, labels).where("predicted = 1").collect())
    one = through("near dedup", good)
    found = brute_components([(r["doc_id"], r["text"]) for r in good.collect()], 80)
    assert ids(one) == sorted(d for d, (_, c) in found.items() if d == c)
    mixed = through("mixing", one)
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += size(r["text"])
    assert taken == Counter({r["doc_id"]: r["taken"] for r in mix(one).where("taken > 0").collect()})
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for r in mixed.collect():
        n = len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], i, min(2048, n - i)) for i in range(0, n, 2048))
    packed = through("packing", mixed).collect()
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in packed) == want
    assert check_sequences(packed) <= -(-sum(r["length"] for r in packed) // 2048) * 1.01 + 1


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_run_on_odd_rows_and_nothing(spark, tmp_path):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 0), (8, 1, 0), (3, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for name, some in (("odd", docs), ("none", docs.limit(0))):
        some.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r["doc_id"] for r in got} <= {None, 1, 4, 5, 3, 6, 7, 8}
    check_sequences(got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def test_dedup_stage_drops_copies_from_jaccard_080_on(spark):
    words = [f"w{i}" for i in range(104)]
    copy = lambda n: " ".join(words[: 104 - n] + [f"x{i}" for i in range(n)])
    # 100 shingles each; a tail of 10 other words leaves 90 of 110 in common (0.818), one of 12 words 88 of 112 (0.786)
    docs = spark.createDataFrame([(1, copy(0)), (2, copy(10)), (10, "y " + copy(0).replace("w", "v")), (11, "y " + copy(12).replace("w", "v"))], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, SF).collect()} == {1, 10, 11}
    assert near_duplicates(docs, percent=85).where("kept").count() == 4


def test_stages_write_few_files(spark):
    """A start of a store's process, which every file costs, counts an executor's memory twice."""
    docs = table(spark, SF, "documents").repartition(100).cache()
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.rdd.getNumPartitions() <= TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    docs.unpersist()
