"""Hybrid retrieval, evaluation, the registry, audit, chunk rows, prompts, budgets and throttles on small fixtures."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexgrid.functions.answer import answer_blocks, citation_url, cited, province_name, system_prompt
from lexgrid.functions.vector import cosine, filled
from lexgrid.operators.audit import audit_rows, fallback_rate, record
from lexgrid.operators.chunking import chunk_clauses, chunk_counts
from lexgrid.operators.evaluation import evaluate, read_suites, suite_scores
from lexgrid.operators.hybrid import PARTS, _met, _spread, hint_of, keyword_for_each, match_chunks, municipality, nearest_for_each, retrieve, retrieve_for_each, search_chunks
from lexgrid.operators.registry import UNVERIFIED, choices, gate, mark_verified, oldest_source, read_registry, record_fetch, registry_errors, request_errors, sync_registry, verification_label
from lexgrid.operators.retrieval import fuse
from lexgrid.operators.store import replace_document
from lexgrid.operators.throttle import refusals
from lexgrid.sources.embedding import EmbeddingError, RateLimiter, Refused, batch_budget, batches, embed_documents, hashed, is_certificate_error

CHUNK = "id long, municipality_id string, language string, section_number string, section_title string, chunk_content string, embedding array<float>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def corpus(spark):
    rows = [(1, "a", "en", "6.3", None, "Fences are low.", [1.0, 0.0]), (2, "a", "en", "6.3(1)", None, "Walls are high.", [0.9, 0.1]), (3, "a", "en", "6.30", None, "Sheds", [0.0, 1.0]), (4, "a", "fr", "6.3", None, "Fences", [1.0, 0.0]), (5, "b", "en", "6.3", None, "Fences are low.", [1.0, 0.0]), (6, "a", "en", "7", None, None, None), (7, "a", "en", "8", None, "low fences", [0.0, 0.0])]
    return spark.createDataFrame(rows, CHUNK)


def refuse(texts, kind):
    raise Refused(500, "down")


def test_hybrid_retrieval_degrades_on_embedding_errors_only(spark):
    both = retrieve(corpus(spark), "what of section 6.3", "a", lambda texts, kind: [(0, [1.0, 0.0])], width=2)
    assert [r["id"] for r in both.chunks.orderBy("fused_rank").collect()] == [1, 2] and not both.degraded and both.hits() == (2, 2)
    from lexgrid.sources import embedding

    alone = retrieve(corpus(spark), "what of section 6.3", "a", lambda texts, kind: [(0, [1.0])], width=2)
    assert alone.degraded and "EmbeddingError" in alone.reason and [r["id"] for r in alone.chunks.orderBy("fused_rank").collect()] == [1, 2] and alone.hits() == (0, 2)
    with pytest.raises(ZeroDivisionError):
        retrieve(corpus(spark), "6.3", "a", lambda texts, kind: 1 / 0, width=2)
    assert embedding.LONGEST > 100_000


def test_wrappers(spark):
    with pytest.raises(ValueError, match="3 numbers"):
        match_chunks(corpus(spark), [1.0, 0.0, 0.0], "a", width=2)
    hits = match_chunks(corpus(spark), [1.0, 0.0], "a", width=2).collect()
    assert [r["id"] for r in hits] == [1, 2] and all(r["score"] == r["similarity"] and r["language"] == "en" for r in hits)
    assert [r["id"] for r in search_chunks(corpus(spark), "tell me of 6.3", "a").collect()] == [1, 2]
    assert [r["id"] for r in search_chunks(corpus(spark), "low fences", "a", hint="7").collect()][0] == 6
    assert hint_of("rule 6.3(1)(a) of section 9") == "6.3(1)(a)" and hint_of("3 metres") is None
    registry = spark.createDataFrame([("a", "A", None, None, None, True)], "id string, name string, source_url string, source_bylaw_name string, languages array<string>, is_active boolean")
    assert municipality(registry, "a")["languages"] == ["en"] and municipality(registry, "z") is None
    lists = spark.createDataFrame([(0, 1, 1, 0.5, None), (1, 1, 2, None, 0.5)], "list int, position int, id long, similarity double, rank double")
    with pytest.raises(Exception, match="no weight for list 1"):
        fuse(lists, {0: 1.0}).collect()


def test_many_questions_equal_one_by_one(spark):
    rows = [(1, "a", "en", "what of section 6.3", [1.0, 0.0]), (2, "a", "en", "low fences", None), (3, "b", "en", "Fences are low", [0.0, 0.0]), (4, "z", "en", "6.3", [1.0, 0.0]), (5, "a", "en", None, [0.0, 1.0])]
    asked = spark.createDataFrame(rows, "q long, municipality_id string, language string, question string, embedding array<float>")
    got = {}
    for r in retrieve_for_each(asked, corpus(spark)).orderBy("q", "fused_rank").collect():
        got.setdefault(r["q"], []).append((r["id"], r["degraded"]))
    assert got == {1: [(1, False), (2, False)], 2: [(7, True), (1, True)], 3: [(5, False)], 5: [(3, False)]}
    assert {(r["q"], r["id"]): round(r["rank"], 2) for r in keyword_for_each(asked, corpus(spark)).where("q = 1").collect()} == {(1, 1): 1.0, (1, 2): 0.9}
    sims = {(r["q"], r["id"]): r["similarity"] for r in nearest_for_each(asked, corpus(spark), 5, -2.0).collect()}
    plain = {(q[0], c["id"]): one(spark, cosine(F.lit(q[4]), F.lit(c["embedding"]))) for q in rows if q[4] and any(q[4]) for c in corpus(spark).collect() if c["embedding"] and any(c["embedding"]) and (c["municipality_id"], c["language"]) == (q[1], q[2])}
    assert sims == pytest.approx(plain)
    assert retrieve_for_each(asked.limit(0), corpus(spark)).count() == 0


def test_batch_searches_move_a_bounded_number_of_copies(spark):
    """Copies of questions don't grow with the shuffle partitions, and the first few of a question are the first of all."""
    texts = [f"fences of lot {i % 7} and {i % 5} yards" for i in range(60)]
    chunks = spark.createDataFrame([(i, "a" if i % 4 else "b", "en", f"{i % 3}.{i % 4}" + "(1)" * (i % 2), t) for i, t in enumerate(texts)], "id long, municipality_id string, language string, section_number string, chunk_content string")
    asked = spark.createDataFrame([(i, "ab"[i % 2], "en", f"{t} section {i % 5}.{i % 6}" if i % 3 else t) for i, t in enumerate(texts)], "q long, municipality_id string, language string, question string")
    order = lambda df: [tuple(r) for r in df.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.col("rank").desc(), "section_number", "id"))).where("at <= 3").orderBy("q", "at").collect()]
    assert order(keyword_for_each(asked, chunks, 3)) == order(keyword_for_each(asked, chunks))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        spread = _spread(asked, chunks)
        blocks = lambda key: spark.createDataFrame([(t, "en", [k], key) for k in range(20) for t in "ab"], f"municipality_id string, language string, ids array<long>, {key} string")
        met = _met(blocks("a").withColumnRenamed("ids", "qs"), blocks("b"), spread, ["municipality_id", "language"])
        assert {r["parts"] for r in spread.collect()} == {PARTS} and met.count() == 2 * 20 * 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_golden_evaluation(spark, tmp_path):
    suite = {"municipality_id": "a", "questions": [{"id": "x", "question": "q", "expect_sections": ["1", "2"], "expect_text": ["low\nWall"]}, {"id": "y", "question": "q", "expect_sections": ["9", "2"], "match": "any"}, {"id": "z", "question": "q", "expect_fallback": True}]}
    (tmp_path / "b.en.json").write_text(json.dumps(suite, indent=1))
    (tmp_path / "a.json").write_text(json.dumps(suite | {"municipality_id": "b", "language": "fr", "questions": []}))
    read = read_suites(spark, str(tmp_path), "a")
    assert [(r["id"], r["language"], r["match"], r["suite"]) for r in read.collect()] == [("x", "en", "all", "b.en.json"), ("y", "en", "any", "b.en.json"), ("z", "en", "all", "b.en.json")]
    asked = read.withColumn("q", F.col("id"))
    found = spark.createDataFrame([("x", 1, "1", "low"), ("x", 2, "2", "Wall"), ("y", 1, "3", "t"), ("y", 9, "2", "too late"), ("z", 1, "5", "t")], "q string, fused_rank int, section_number string, chunk_content string")
    got = {r["q"]: (r["passed"], r["failures"]) for r in evaluate(asked, found).collect()}
    assert got == {"x": (True, []), "y": (False, ["none of 9, 2"]), "z": (False, ["expected no retrieval"])}
    nothing = {r["q"]: r["failures"] for r in evaluate(asked, found.limit(0)).collect()}
    assert nothing == {"x": ["missing 1, 2", "text not found: low\nWall"], "y": ["none of 9, 2"], "z": []}
    scores = suite_scores(evaluate(asked, found.withColumn("degraded", F.col("q") == "x")), 0.3, strict=True).first()
    assert (scores["questions"], scores["passed"], scores["degraded"], scores["good"]) == (3, 1, True, False)


def test_registry(spark, tmp_path):
    good = {"id": "nb_a", "province_code": "NB", "name": "A", "languages": ["en"], "is_active": True, "status": "ready", "sources": [{"language": "en", "source_url": "https://a", "source_type": "pdf"}]}
    bad = {"id": "x_b", "province_code": "NB", "name": "B", "status": "blocked_needs_decision", "is_active": True, "bylaw_last_verified_at": "2024-01-01", "sources": [{"language": "fr", "source_url": "http://b"}]}
    (tmp_path / "r.json").write_text(json.dumps({"municipalities": [good, bad, good | {"id": "on_c", "languages": ["iu"], "province_code": "XX", "sources": [], "status": None}, good]}, indent=1))
    entries = read_registry(spark, str(tmp_path / "r.json"))
    got = {}
    for r in registry_errors(entries).collect():
        got.setdefault(r["id"], set()).add(r["error"])
    assert got == {
        "nb_a": {"id comes more than once"},
        "x_b": {"id does not begin with its province", "languages are empty", "active although blocked", "source_url is not https", "source language is not declared", "source_type is neither pdf nor html", "verified without verified_by"},
        "on_c": {"province_code is no province", "id does not begin with its province", "languages beyond those stored", "status is unknown", "active without sources"},
    }
    assert [tuple(r) for r in registry_errors(entries.limit(0)).collect()] == [(None, "no municipalities")]
    assert [r["id"] for r in choices(entries.dropDuplicates(["id"]), "NB").collect()] == ["nb_a", "x_b"]
    table = sync_registry(spark.createDataFrame([("nb_a", "NB", "Old", "b", "u", ["en"], False, "2024-05-01")], "id string, province_code string, name string, source_bylaw_name string, source_url string, languages array<string>, is_active boolean, bylaw_last_verified_at string").withColumn("bylaw_last_verified_at", F.col("bylaw_last_verified_at").cast("date")), entries.where("id = 'nb_a'").limit(1))
    row = table.first()
    assert (table.count(), row["name"], row["is_active"], str(row["bylaw_last_verified_at"])) == (1, "A", True, "2024-05-01")


LEDGER = "municipality_id string, language string, bylaw_name string, source_url string, source_type string, content_hash string, last_fetched_at string, document_version string, last_verified_at date"


def test_ledger(spark):
    ledger = spark.createDataFrame([("a", "en", "b", "u", "pdf", "h0", "t0", "v1", None), ("a", "fr", "b", "u", "pdf", "h0", "t0", None, None)], LEDGER)
    towns = spark.createDataFrame([("a", None)], "id string, bylaw_last_verified_at date")
    fetched = spark.createDataFrame([("a", "en", "b", "u2", "pdf", "h1", "t1", ""), ("a", "fr", "b", "u2", "pdf", "h1", "t1", "v2")], LEDGER.rsplit(",", 1)[0])
    towns, checked = mark_verified(towns, ledger, "a", "2024-05-01", language="en")
    assert str(towns.first()[1]) == "2024-05-01" and oldest_source(checked).first()[1] is None
    after = {r["language"]: (r["content_hash"], r["document_version"], str(r["last_verified_at"])) for r in record_fetch(checked, fetched).collect()}
    assert after == {"en": ("h1", "v1", "2024-05-01"), "fr": ("h1", "v2", "None")}
    _, checked = mark_verified(towns, checked, "a", "2023-01-01", language="fr")
    assert str(oldest_source(checked).first()[1]) == "2023-01-01"
    assert one(spark, verification_label(F.lit(None).cast("date"))) == UNVERIFIED and one(spark, verification_label(F.to_date(F.lit("2024-05-01")))).endswith("verified 2024-05-01")


def test_documents_are_replaced_whole(spark):
    ddl = "id int, doc string, text string"
    now = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], ddl)
    new = spark.createDataFrame([(1, "a", "X")], ddl)
    rows = lambda df: sorted(map(tuple, df.select("id", "doc", "text").collect()))
    assert rows(replace_document(now, new, ["id", "doc"], ["doc"])) == [(1, "a", "X"), (3, "b", "z")]
    assert rows(replace_document(now, new.limit(0), ["id", "doc"], ["doc"])) == rows(now)


def test_requests(spark):
    ddl = "request int, query string, municipality_id string, province_code string, language string, session_id string"
    rows = [(1, "  why? ", "a", "NB", None, None), (2, "  x ", "", "XX", "de", "s" * 65), (3, None, None, None, "fr", "s"), (4, "x" * 1001, "a" * 65, "NB", "en", None)]
    got = {}
    for r in request_errors(spark.createDataFrame(rows, ddl)).collect():
        got.setdefault(r["request"], []).append(r["error"])
    assert got == {2: ["query", "municipality_id", "province_code", "language", "session_id"], 3: ["query", "municipality_id", "province_code"], 4: ["query", "municipality_id"]}
    assert [one(spark, gate(F.lit(f), F.lit(a))) for f, a in ((None, True), (True, None), (True, True))] == [404, 409, 200]


def test_audit(spark, tmp_path):
    ddl = "municipality_id string, user_query string, chunk_ids array<long>, response_text string, was_fallback boolean, language string, session string"
    rows = audit_rows(spark.createDataFrame([("a", "q", [7], "x" * 20_001, None, "en", "secret"), ("a", "q", None, None, None, "en", "s"), ("a", "q", [], "y", False, "en", "s")], ddl))
    assert "session" not in rows.columns and sorted((r["was_fallback"], r["retrieved_chunk_ids"]) for r in rows.collect()) == [(False, []), (False, ["7"]), (True, [])]
    assert record(rows, str(tmp_path / "log")) and record(rows, str(tmp_path / "log"))
    assert tuple(fallback_rate(spark.read.parquet(str(tmp_path / "log"))).first()) == (2, 6)
    (tmp_path / "file").write_text("in the way")
    assert record(rows, str(tmp_path / "file" / "log")) is False


def test_chunk_rows(spark):
    ddl = "seq int, municipality_id string, municipality_name string, province_code string, bylaw_name string, language string, section_number string, section_title string, text string, page_number int, page_label string, part_number string, part_title string, parent_number string, parent_title string, amendments array<string>, source_url string, document_version string"
    rows = [(1, "a", "A", "NB", "By", "en", "6.4", "Signs", "One.\n(a) two\n(b) three", 3, "8-3", "6", "Signs", None, None, ["Z-1.2"], "https://a", None), (2, "a", "A", "NB", "By", "en", "6.4", None, "Again", 4, None, None, None, "6", "Zone", None, None, "v"), (3, "a", "A", "NB", "By", "en", "6.5", None, " ", 4, None, None, None, None, None, None, None, None)]
    made = chunk_clauses(spark.createDataFrame(rows, ddl), limit=12).orderBy("seq", "part")
    got = made.collect()
    assert [(r["section_number"], r["part"], r["parts"], r["chunk_index"]) for r in got] == [("6.4", 1, 1, 0), ("6.4", 1, 1, 1)] or len(got) > 2
    assert got[-1]["chunk_content"] == "[Province: NB] [Municipality: A] [Bylaw: By] [6 Zone]\nSection 6.4:\nAgain" and got[-1]["chunk_index"] == len(got) - 1
    assert got[0]["chunk_content"].startswith("[Province: NB] [Municipality: A] [Bylaw: By] [Part 6: Signs]\nSection 6.4 Signs")
    first, last = json.loads(got[0]["metadata"]), json.loads(got[-1]["metadata"])
    base = {"province": "NB", "municipality": "a", "bylaw": "By", "section": "6.4", "language": "en"}
    assert last == base | {"section_title": None, "page": 4, "url": None, "document_version": "v", "parent_section": "6", "parent_title": "Zone"}
    assert first["amendments"] == ["Z-1.2"] and first["page_label"] == "8-3" and first["part_title"] == "Signs"
    assert tuple(chunk_counts(made).first())[3:] == (1, len(got), int(len(got) > 2))


def test_prompts_and_answers(spark):
    passage = F.struct(F.lit(1).alias("position"), F.lit("[A - B, Section 1]").alias("citation"), F.lit(None).cast("string").alias("title"), F.lit(4).alias("page"), F.lit("text {fallback}").alias("content"))
    said = one(spark, system_prompt(F.lit("Moncton"), F.lit("NB"), F.lit("fr"), F.lit(None).cast("date"), F.array(passage)))
    assert "answering for Moncton, New Brunswick." in said and "text {fallback}" in said and "7. Answer in French." in said and said.endswith("*") and "\n*Avis :" in said
    assert one(spark, province_name(F.lit("ZZ"))) == "ZZ"
    answer = "Intro **bold** [A - By, Section 6.3(1)] end\n\n- first [A - By, Section 7]\n* second\n*Disclaimer: x*"
    blocks = one(spark, answer_blocks(F.lit(answer)))
    assert [(b["kind"], b["text"]) for b in blocks] == [("paragraph", answer.split("\n")[0]), ("bullet", "first [A - By, Section 7]"), ("bullet", "second"), ("disclaimer", "Disclaimer: x")]
    assert [tuple(s) for s in blocks[0]["spans"]] == [("text", "Intro "), ("bold", "bold"), ("text", " "), ("citation", "6.3(1)"), ("text", " end")]
    assert [tuple(c) for c in one(spark, cited(F.lit(answer)))] == [("A - By", "6.3(1)"), ("A - By", "7")]
    assert one(spark, citation_url(F.lit('{"url":""}'), F.lit("own"))) == "own" and one(spark, citation_url(F.lit('{"url":"u"}'), F.lit("own"))) == "u"
    assert one(spark, filled(4, 0.5, 1, 2)) == [1.0, 2.0, 0.5, 0.5]


def test_budgets_and_paces(spark):
    assert batch_budget(100_000, 10_000, 3) == 2833 and batch_budget(50, 0, 3) == 50 and batch_budget(10, 1, 1) == 1
    assert [len(b) for b in batches(["x"] * 250)] == [96, 96, 58]
    assert [len(b) for b in batches(["x" * 35, "y" * 35, "z" * 700, "w"], 96, 22)] == [2, 1, 1]
    limiter, clock, slept = RateLimiter(2, 100), [0.0], []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    for n in (10, 10, 10, 500):
        limiter.pace(n, sleep, lambda: clock[0])
    assert slept == [60.5, 60.5] and RateLimiter(0, 0).wait(10**9, 0.0) == 0.0
    rows = spark.createDataFrame([("a",), (" ",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="input 1 is empty"):
        embed_documents(rows, "t", lambda: hashed(4), 4).collect()
    assert embed_documents(rows.limit(1), "t", lambda: hashed(4), 4, rates=(3, 10_000)).count() == 1
    assert is_certificate_error(OSError("CERTIFICATE_VERIFY_FAILED: certificate")) and not is_certificate_error("timeout") and issubclass(EmbeddingError, RuntimeError)


def test_two_limits(spark):
    at = [(1, i, f"2024-01-01 00:00:{i:02d}") for i in range(4)] + [(1, 9, "2024-01-01 00:02:00"), (1, 10, "2024-01-01 00:03:00"), (2, 11, "2024-01-01 00:03:00")]
    got = {r["e"]: r["refused"] for r in refusals(spark.createDataFrame(at, "c int, e int, ts string"), "c", "ts", ("e",), ((2, "1 minute"), (5, "1 day"))).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 9: False, 10: True, 11: False}


def test_extractors(spark):
    """One word a byte here; a file that can't be read is a row of its own."""

    def extract(content):
        if content == b"bad":
            raise ValueError("no pages")
        return ((i + 1, chr(b), 0.0, 6.0, 10.0, 21.0, False) for i, b in enumerate(content))

    files = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"bad")), (3, None)], "document long, content binary")
    from lexgrid.sources.extract import words_of

    got = words_of(files, extract, 2).collect()
    assert sorted((r["document"], r["page"], r["text"], r["error"]) for r in got if r["document"] == 1) == [(1, 2, "b", None), (1, 3, "c", None)]
    assert [(r["document"], r["error"]) for r in got if r["error"]] == [(2, "ValueError: no pages")] and words_of(files.limit(0), extract).count() == 0


def test_views_stay_fresh(spark):
    from lexgrid.sources.fresh import FRESH, FreshViews

    now, reads = [0.0], []

    def read(name):
        reads.append(name)
        if len(reads) == 1:
            raise OSError("once")
        return spark.range(3)

    views = FreshViews(read, 5, lambda: now[0])
    assert len(views.get("a")) == len(views.get("a")) == 3 and reads == ["a", "a"]
    now[0] = FRESH
    views.get("a")
    views.refresh("a")
    views.get("a")
    assert len(reads) == 4
    with pytest.raises(ValueError, match="more than 2"):
        FreshViews(lambda name: spark.range(3), 2).get("b")


def test_two_limits_in_one_stream(spark, tmp_path):
    from lexgrid.streaming.streams import drain, throttles

    at = [*(f"2024-01-01 00:00:{s:02d}" for s in range(4)), "2024-01-01 09:00:00", "2024-01-09 00:00:00"]
    spark.createDataFrame([(1, t) for t in at], "client long, ts string").coalesce(1).write.parquet(f"{tmp_path}/r")
    requests = spark.readStream.schema("client long, ts string").parquet(f"{tmp_path}/r")
    found = drain(throttles(requests, "client", "ts", {"1 minute": 3, "1 day": 4}, "1 hour")).where("refused > 0").collect()
    assert sorted((r["every"], r["n"], r["refused"]) for r in found) == [("1 day", 5, 1), ("1 minute", 4, 1)]


def test_limiter_states_outlive_its_seconds(spark):
    from lexgrid.streaming.streams import sliding_limiter

    with pytest.raises(ValueError, match="outlive"):
        sliding_limiter(spark.range(1), "id", "id", 1, 60.0, idle=1000)
