"""Providers, source selection, outcomes, readiness and answers on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lexgrid.operators.answering import CUT_SHORT, bodies, events, readiness
from lexgrid.operators.ingest import failures, selected, summary
from lexgrid.operators.store import replace_table
from lexgrid.settings import Settings, settings
from lexgrid.sources.embedding import ATTEMPTS, LONGEST, WAITS, EmbeddingError, QuotaExhausted, Refused, aligned, embed_documents, embed_query, hashed, joined, parts_of, patient


def replies(*steps):
    """A provider that fails as told, then answers; and the sleeps it was given."""
    left, slept = list(steps), []

    def call(texts, kind):
        if left:
            raise left.pop(0)
        return [(i, [0.0]) for i in range(len(texts))]

    return call, slept


def test_retries():
    call, slept = replies(Refused(500), OSError("gone"), Refused(503))
    assert patient(call, ["a"], "document", slept.append, lambda a, b: b) == [(0, [0.0])] and slept == [1.0, 2.0, 4.0]
    call, slept = replies(*[Refused(429)] * WAITS, *[Refused(500)] * (ATTEMPTS - 1))
    assert patient(call, ["a"], "document", slept.append, lambda a, b: a) and slept == [61.0] * WAITS + [0] * (ATTEMPTS - 1)
    for steps, error in (([Refused(500)] * ATTEMPTS, EmbeddingError), ([Refused(400)], EmbeddingError), ([Refused(429)] * (WAITS + 1), EmbeddingError), ([Refused(402)], QuotaExhausted), ([Refused(429, "Quota reached")], QuotaExhausted)):
        with pytest.raises(error):
            patient(replies(*steps)[0], ["a"], "document", lambda s: None)


def test_vectors_follow_their_index():
    assert aligned([(1, [2.0]), (0, [1.0])], ["a", "b"], 1) == [[1.0], [2.0]]
    for reply in ([(0, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])]):
        with pytest.raises(EmbeddingError):
            aligned(reply, ["a", "b"], 1)
    assert embed_query(" Front yard ", hashed(8), 8) == embed_query("front  YARD", hashed(8), 8)
    with pytest.raises(EmbeddingError):
        embed_query("  ", hashed(8), 8)


def test_embedding_of_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, " "), (4, "a b")], "id long, t string")
    found = {r["id"]: r["embedding"] for r in embed_documents(rows, "t", lambda: hashed(4), 4, batch=1, blank="null").collect()}
    assert found[2] is found[3] is None and found[1] == found[4] and len(found[1]) == 4


def test_long_texts_are_embedded_whole(spark):
    rows = spark.createDataFrame([(1, "front " * 20_000 + "yard " * 20_000), (2, "x" * (2 * LONGEST + 1)), (3, "yard")], "id long, t string").coalesce(1)
    found = {r["id"]: r["embedding"] for r in embed_documents(rows, "t", lambda: hashed(64), 64, long="parts").collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in found.values())
    assert all(sum(a * b for a, b in zip(found[1], v, strict=True)) > 0.4 for v in (found[3], embed_query("front", hashed(64), 64)))
    with pytest.raises(Exception, match="input 0 has more than"):  # the first row of a batch, too
        embed_documents(rows.where("id = 1"), "t", lambda: hashed(64), 64).collect()
    assert parts_of("ab cd  ef", 4) == ["ab ", "cd  ", "ef"] and parts_of("abcde    ", 3) == ["abc", "de "] and joined([[1.0, 0.0], [-1.0, 0.0]], ["a", "b"]) == [1.0, 0.0]


REGISTRY = "id string, is_active boolean, status string, interleaved boolean, sources array<struct<language:string,bylaw_name:string,source_url:string>>, source_url string, languages array<string>, source_bylaw_name string"


def test_selection(spark):
    two = [("en", "By", "u"), ("fr", "Ar", "u")]
    registry = spark.createDataFrame([("a", True, None, False, two, None, None, None), ("b", True, None, True, two, None, None, None), ("c", False, "draft", None, two, None, None, None), ("d", True, None, None, None, "own", None, "D"), ("e", None, None, None, [], "", None, None), ("f", True, None, None, [], None, None, None)], REGISTRY)
    got = lambda **kw: {(r["id"], r["language"], tuple(r["also_languages"] or ()), r["status"]) for r in selected(registry, **kw).collect()}
    assert got() == {("a", "en", ("fr",), None), ("b", "en", (), None), ("b", "fr", (), None), ("d", "en", (), None), ("f", None, (), "no_source")}
    assert got(municipality="c") == {("c", None, (), "skipped_inactive")}
    assert got(municipality="c", include_inactive=True) == {("c", "en", ("fr",), None)}
    assert {r[0] for r in got(language="fr")} == {"b", "f"}


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([], "id string, language string, status string, clauses long, chunks long, upserted long, deleted long, detail string")
    assert summary(none).orderBy("block", "k").collect()[-1]["line"] == "0 source(s): 0 chunks written, 0 unchanged, 0 failed"
    assert failures(none).first()["exit_code"] == 0
    assert failures(none.sparkSession.createDataFrame([("error",), (None,)], "status string")).first().asDict() == {"sources": 2, "failed": 1, "exit_code": 1}


def test_readiness(spark):
    probes = spark.createDataFrame([(1, "store", True), (1, "key", None), (2, "key", True), (3, "store", False)], "probe int, name string, ok boolean")
    assert {r["probe"]: (r["status"], r["http_status"]) for r in readiness(probes).collect()} == {1: ("degraded", 200), 2: ("ok", 503), 3: ("degraded", 503)}
    assert {r["probe"]: r["http_status"] for r in readiness(probes, deep=True).collect()} == {1: 503, 2: 200, 3: 503}


def test_answers(spark):
    ddl = "request int, language string, verified_on date, citations array<string>, tokens array<string>, finish string, failed boolean"
    rows = [(1, "en", None, ["S"], ["Yes", "", " *Disclaimer: x"], "stop", False), (2, "fr", None, ["S"], ["Oui"], "length", None), (3, "en", None, [], ["no"], None, False), (4, "en", None, None, None, None, None), (5, "en", None, ["S"], ["par\n\"t"], None, True)]
    e = events(spark.createDataFrame(rows, ddl))
    said = {r["request"]: r["x"] for r in e.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "type", "data"))), lambda x: F.struct(x["type"], x["data"])).alias("x")).collect()}
    kinds = {k: [t for t, _ in v] for k, v in said.items()}
    assert kinds == {1: ["citations", "token", "token", "done"], 2: ["citations", "token", "token", "token", "done"], 3: ["citations", "token", "token", "done"], 4: ["error"], 5: ["citations", "token", "error"]}
    assert said[2][2][1] == CUT_SHORT["fr"] and said[2][3][1].startswith("\n\n*Avis :") and "no" not in [d for _, d in said[3]]
    body = {r["request"]: r["body"] for r in bodies(e).collect()}
    assert body[5].split("\r\n\r\n")[1] == 'event: token\r\ndata: {"type":"token","data":"par\\n\\"t"}' and body[1].endswith('data: {"type":"done","data":null}\r\n\r\n')
    assert body[1].startswith('event: citations\r\ndata: {"type":"citations","data":["S"]}')


def test_settings(spark):
    assert settings(environ={}) == Settings() and settings(spark, {}).match_threshold == 0.3
    got = settings(environ={"LEXGRID_STORE_URL": "https://store.example//", "LEXGRID_MATCH_THRESHOLD": "0.5", "LEXGRID_DEFAULT_LANGUAGE": ""})
    assert (got.store_url, got.match_threshold, got.default_language) == ("https://store.example", 0.5, "en")
    spark.conf.set("lexgrid.rate_limit_per_day", "7")
    assert settings(spark, {"LEXGRID_RATE_LIMIT_PER_DAY": "9"}).rate_limit_per_day == 7
    spark.conf.unset("lexgrid.rate_limit_per_day")
    for wrong in ({"store_url": "http://x"}, {"embedding_dimensions": 512}, {"environment": "moon"}):
        with pytest.raises(ValueError):
            Settings(**wrong)


def test_layout_keeps_types_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(1, "001", "en", "2.1"), (2, None, "fr", "1.1"), (3, "001", "en", None)], "id long, municipality_id string, language string, section_number string")
    path = replace_table(spark, rows, str(tmp_path), ["id"], ("municipality_id", "language"), ("section_number",))
    read = spark.read.schema(rows.schema).parquet(path).select(*rows.columns)
    assert sorted(read.collect()) == sorted(rows.collect())
    assert "PartitionFilters: [isnotnull(municipality_id" in read.where("municipality_id = '001'")._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="repeat"):
        replace_table(spark, rows.unionByName(rows), str(tmp_path), ["id"], ("language",))
