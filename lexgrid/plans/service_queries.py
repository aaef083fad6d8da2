"""Throttling, validation, audit, answering and governance queries q35 to q47 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrid.functions.answer import FALLBACK, UNVERIFIED, VERIFIED, client_key, context, disclaimer, frames, has_disclaimer
from lexgrid.operators.audit import audit_rows, fallback_rate
from lexgrid.operators.checks import cascade, role_view
from lexgrid.operators.evaluation import evaluate, suite_scores
from lexgrid.operators.hybrid import retrieve_for_each
from lexgrid.operators.registry import PROVINCES, STATES, gate, registry_errors
from lexgrid.operators.store import insert_missing, upsert
from lexgrid.operators.throttle import refusals
from lexgrid.plans.retrieval_queries import GOLDEN_SQL, golden_questions
from lexgrid.session import ship
from lexgrid.sources.tables import CHUNKS_SQL, chunks, table


def q35_rate_limit_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Requests and tokens of a user in the hour up to each event, and whether a limit is passed."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_599_999_999, 0)
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count("*").over(w).alias("requests"), F.round(F.sum("value").over(w), 4).alias("tokens")).withColumn("limited", F.col("requests") > 2)


Q35 = """SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens, count(*) OVER w > 2 AS limited FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW)"""


def q36_throttle_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Requests per client key and day, and how many two limits refuse: two an hour, five a day; half of the clients send a session."""
    session = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" s"), (F.col("event_id") % 2).cast("string"))).otherwise("  ")
    keyed = table(spark, d, "events").select("event_id", "ts", client_key(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")), session).alias("client"))
    judged = refusals(keyed, "client", "ts", ("event_id",), ((2, "1 hour"), (5, "1 day")))
    return judged.groupBy("client", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"))


Q36 = """WITH e AS (SELECT '10.0.0.' || user_id || CASE WHEN user_id % 2 = 0 THEN ':s' || (event_id % 2) ELSE '' END AS client, ts, event_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY client, date_trunc('hour', ts) ORDER BY ts, event_id) AS h, row_number() OVER (PARTITION BY client, date_trunc('day', ts) ORDER BY ts, event_id) AS d FROM e)
SELECT client, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE h > 2 OR d > 5) AS refused FROM n GROUP BY ALL"""


def q37_registry_validation(spark: SparkSession, d: str) -> DataFrame:
    """Nations as registry entries whose facts follow from their keys, held against the registry's rules."""
    k = F.col("n_nationkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    code = pick((*PROVINCES, "XX", ""), k)
    name = F.when(k >= 23, "nb_twin").otherwise(F.concat(F.when(k % 6 == 0, "zz").otherwise(F.lower(code)), F.lit("_"), k.cast("string")))
    languages = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("en"))).when(k % 4 == 2, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("en"), F.lit("de")))
    source = F.struct(F.when(k % 7 == 0, "fr").otherwise("en").alias("language"), F.lit("b").alias("bylaw_name"), F.when(k % 8 == 0, "http://x").otherwise("https://x").alias("source_url"), F.when(k % 9 == 0, "doc").otherwise("pdf").alias("source_type"), F.lit(None).cast("string").alias("document_version"))
    entries = table(spark, d, "nation").select(name.alias("id"), code.alias("province_code"), languages.alias("languages"), (k % 2 == 0).alias("is_active"), pick((*STATES, "odd"), k).alias("status"), F.when(k % 10 == 0, "2024-01-01").alias("bylaw_last_verified_at"), F.when(k % 20 == 0, "someone").alias("verified_by"), F.when(k % 3 != 0, F.array(source)).alias("sources"))
    return registry_errors(entries)


def _literals(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


Q37 = f"""WITH c AS (SELECT n_nationkey AS k, [{_literals((*PROVINCES, "XX", ""))}][n_nationkey % 15 + 1] AS code, [{_literals((*STATES, "odd"))}][n_nationkey % 5 + 1] AS status FROM nation),
e AS (SELECT *, CASE WHEN k >= 23 THEN 'nb_twin' ELSE CASE WHEN k % 6 = 0 THEN 'zz' ELSE lower(code) END || '_' || k END AS id, CASE k % 4 WHEN 0 THEN [] WHEN 1 THEN ['en'] WHEN 2 THEN ['en', 'fr'] ELSE ['en', 'de'] END AS languages FROM c)
SELECT id, 'province_code is no province' AS error FROM e WHERE code IN ('XX', '') UNION ALL SELECT id, 'id does not begin with its province' FROM e WHERE code <> '' AND NOT starts_with(id, lower(code) || '_')
UNION ALL SELECT id, 'languages are empty' FROM e WHERE k % 4 = 0 UNION ALL SELECT id, 'languages beyond those stored' FROM e WHERE k % 4 = 3 UNION ALL SELECT id, 'status is unknown' FROM e WHERE status = 'odd'
UNION ALL SELECT id, 'active without sources' FROM e WHERE k % 2 = 0 AND k % 3 = 0 UNION ALL SELECT id, 'active although blocked' FROM e WHERE k % 2 = 0 AND starts_with(status, 'blocked')
UNION ALL SELECT id, 'source_url is not https' FROM e WHERE k % 3 <> 0 AND k % 8 = 0 UNION ALL SELECT id, 'source language is not declared' FROM e WHERE k % 3 <> 0 AND NOT list_contains(languages, CASE WHEN k % 7 = 0 THEN 'fr' ELSE 'en' END)
UNION ALL SELECT id, 'source_type is neither pdf nor html' FROM e WHERE k % 3 <> 0 AND k % 9 = 0 UNION ALL SELECT id, 'verified without verified_by' FROM e WHERE k % 10 = 0 AND k % 20 <> 0
UNION ALL SELECT id, 'id comes more than once' FROM e GROUP BY id HAVING count(*) > 1"""


def q38_dedupe_by_host(spark: SparkSession, d: str) -> DataFrame:
    """First page of every host, and the languages in the paths of all its pages."""
    host, lang = F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)
    return table(spark, d, "pages").groupBy(host.alias("host")).agg(F.min("page_id").alias("first_page"), F.min_by("url", "page_id").alias("url"), F.array_join(F.sort_array(F.collect_set(lang)), ",").alias("languages"), F.count("*").alias("n"))


Q38 = """SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, min(page_id) AS first_page, arg_min(url, page_id) AS url, array_to_string(list_sort(list(DISTINCT regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1))), ',') AS languages, count(*) AS n FROM pages GROUP BY 1"""


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """Question and next answer of every user turn; a third retrieved nothing, and some override the fallback mark."""
    c = table(spark, d, "conversations")
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_query"))
    k = F.col("conv_id") + F.col("turn")
    ids = F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("conv_id"), F.col("turn")))
    rows = q.join(a, ["conv_id", "turn"], "left").withColumns({"chunk_ids": ids, "was_fallback": F.when(k % 7 == 0, F.lit(False)), "response_text": F.coalesce(F.repeat("answer", 40), F.lit("")), "municipality_id": F.lit("m"), "language": F.lit("en")})
    return audit_rows(rows, "conv_id", "turn")


_AUDIT = """a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations), q AS (SELECT conv_id, turn, text AS user_query FROM conversations WHERE role = 'user'),
l AS (SELECT conv_id, turn, user_query, coalesce(repeat(answer, 40), '') AS r, CASE WHEN (conv_id + turn) % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS retrieved FROM q LEFT JOIN a USING (conv_id, turn)),
audit AS (SELECT conv_id, turn, user_query, CASE WHEN length(r) > 20000 THEN left(r, 20000) || '... [truncated]' ELSE r END AS response_text, retrieved, CASE WHEN (conv_id + turn) % 7 = 0 THEN false ELSE retrieved = 0 END AS was_fallback FROM l)"""


def q39_audit_rows(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).select("conv_id", "turn", "user_query", "response_text", F.size("retrieved_chunk_ids").cast("long").alias("retrieved"), "was_fallback")


def q40_fallback_rate(spark: SparkSession, d: str) -> DataFrame:
    return fallback_rate(_audit(spark, d))


def q41_context_block(spark: SparkSession, d: str) -> DataFrame:
    """The first three chunks of every tenant and language as a numbered context."""
    w = Window.partitionBy("municipality_id", "language").orderBy("id")
    top = chunks(spark, d).withColumn("position", F.row_number().over(w)).where("position <= 3")
    citation = F.format_string("[%s - %s, Section %s]", "municipality_id", "language", "section_number")
    title = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Title "), F.col("id").cast("string")))
    passage = F.struct("position", citation.alias("citation"), title.alias("title"), F.when(F.col("id") % 5 != 0, F.col("page_number")).alias("page"), F.col("chunk_content").alias("content"))
    return top.groupBy("municipality_id", "language").agg(context(F.collect_list(passage)).alias("context"))


Q41 = f"""WITH {CHUNKS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY municipality_id, language ORDER BY id) AS position FROM chunks QUALIFY position <= 3)
SELECT municipality_id, language, string_agg('[Passage ' || position || '] CITE AS: [' || municipality_id || ' - ' || language || ', Section ' || section_number || ']' || CASE WHEN id % 2 = 0 THEN chr(10) || 'Section title: Title ' || id ELSE '' END
  || CASE WHEN id % 5 <> 0 THEN chr(10) || 'Page: ' || page_number ELSE '' END || chr(10) || chunk_content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context FROM t GROUP BY ALL"""


def q42_prompt_disclaimer(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the disclaimer of their language and verification date, added only where it is missing; 404 and 409 gates."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    verified = F.when(F.col("quality") == 1, F.to_date(F.lit("2024-05-01")))
    note = disclaimer(F.col("lang"), verified)
    answer = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text"), note)).when(F.col("doc_id") % 4 == 1, F.when(F.col("lang") == "fr", FALLBACK["fr"]).otherwise(FALLBACK["en"])).otherwise(F.col("text"))
    full = F.when(has_disclaimer(answer), answer).otherwise(F.concat(answer, note))
    return t.select("doc_id", F.sha2(full, 256).alias("digest"), has_disclaimer(answer).alias("had"), gate(F.col("quality").isNotNull(), F.col("quality") == 1).alias("status"))


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_NOTE = f"CASE WHEN quality = 1 THEN replace(CASE WHEN lang = 'fr' THEN {_quote(VERIFIED['fr'])} ELSE {_quote(VERIFIED['en'])} END, '{{verified_on}}', '2024-05-01') WHEN lang = 'fr' THEN {_quote(UNVERIFIED['fr'])} ELSE {_quote(UNVERIFIED['en'])} END"
Q42 = f"""WITH t AS (SELECT d.*, quality, {_NOTE} AS note FROM documents d LEFT JOIN labels USING (doc_id)),
a AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN text || note WHEN 1 THEN CASE WHEN lang = 'fr' THEN {_quote(FALLBACK['fr'])} ELSE {_quote(FALLBACK['en'])} END ELSE text END AS answer FROM t)
SELECT doc_id, sha256(CASE WHEN contains(answer, '*Disclaimer:') OR contains(answer, '*Avis :') THEN answer ELSE answer || note END) AS digest, contains(answer, '*Disclaimer:') OR contains(answer, '*Avis :') AS had,
CASE WHEN quality IS NULL THEN 404 WHEN quality = 0 THEN 409 ELSE 200 END::INTEGER AS status FROM a"""


def q43_sse_parse(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as event frames, with both line ends and a frame that is no JSON, and read back."""
    eol = F.when(F.col("conv_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    data = F.to_json(F.struct(F.col("role").alias("type"), F.length("text").alias("data")))
    frame = F.concat(F.lit("event: "), F.col("role"), eol, F.lit("data: "), data, eol, eol)
    body = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", frame.alias("f")))), lambda x: x["f"]), "").alias("b"))
    read = body.select("conv_id", F.posexplode(frames(F.concat(F.lit("data: {broken\n\n"), "b"))).alias("seq", "e"))
    return read.select("conv_id", F.col("seq").cast("long").alias("seq"), F.col("e.event").alias("event"), F.get_json_object("e.data", "$.data").cast("long").alias("chars"))


Q43 = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role AS event, length(text)::BIGINT AS chars FROM conversations"


def q44_golden_eval(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as golden questions in eight suites, answered by hybrid retrieval and held against expected sections, texts and fallbacks."""
    ship(spark)
    asked = golden_questions(spark, d)
    chunked = chunks(spark, d)
    found = retrieve_for_each(asked, chunked, vectors=chunks(spark, d, vectors=True)).join(chunked.select("id", "section_number", "chunk_content"), "id")
    return suite_scores(evaluate(asked, found)).withColumn("score", F.round("score", 6))


Q44 = f"""{GOLDEN_SQL},
g AS (SELECT r.q, list(c.section_number ORDER BY fused_rank) AS sections, string_agg(c.chunk_content, chr(10) ORDER BY fused_rank) AS corpus FROM r JOIN chunks c ON r.id = c.id WHERE fused_rank <= 8 GROUP BY 1),
e AS (SELECT q.suite, q.embedding IS NULL AND g.q IS NOT NULL AS degraded, CASE WHEN q.expect_fallback THEN g.q IS NULL ELSE
  CASE WHEN q.match = 'any' THEN len(q.expect_sections) = 0 OR list_has_any(coalesce(g.sections, []), q.expect_sections) ELSE list_has_all(coalesce(g.sections, []), q.expect_sections) END
  AND len(list_filter(q.expect_text, lambda x: NOT contains(coalesce(g.corpus, ''), x))) = 0 END AS passed FROM q LEFT JOIN g ON q.q = g.q)
SELECT suite, count(*) AS questions, count(*) FILTER (WHERE passed) AS passed, round(avg(passed::INT), 6) AS score, bool_or(degraded) AS degraded, avg(passed::INT) >= 0.85 AS good FROM e GROUP BY 1"""


def q45_role_views(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("is_active", F.col("n_nationkey") % 3 == 0)
    views = [role_view(n, r, F.col("is_active")).groupBy("n_regionkey").agg(F.count("*").alias("visible")).withColumn("role", F.lit(r)) for r in ("service", "public")]
    return views[0].unionByName(views[1])


Q45 = "SELECT n_regionkey, count(*) AS visible, 'service' AS role FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, count(*), 'public' FROM nation WHERE n_nationkey % 3 = 0 GROUP BY 1"


def q46_fk_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Deleting a region takes its nations and their customers along."""
    _, _, customers = cascade(table(spark, d, "region"), F.col("r_regionkey") == 1, [(table(spark, d, "nation"), "n_regionkey", "r_regionkey"), (table(spark, d, "customer"), "c_nationkey", "n_nationkey")])
    return customers.groupBy("c_nationkey").agg(F.count("*").alias("customers"))


Q46 = "SELECT c_nationkey, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 GROUP BY 1"


def q47_seed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Seeds that change nothing where their key is there, then seeds that replace what is there."""
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    more = r.select((F.col("r_regionkey") + 3).alias("r_regionkey"), F.concat(F.lit("seed "), F.col("r_name")).alias("r_name"))
    return upsert(insert_missing(r, more, ["r_regionkey"]), more.where("r_regionkey = 4"), ["r_regionkey"])


Q47 = """WITH m AS (SELECT r_regionkey + 3 AS r_regionkey, 'seed ' || r_name AS r_name FROM region), u AS (SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM m WHERE r_regionkey NOT IN (SELECT r_regionkey FROM region))
SELECT u.r_regionkey, coalesce(m.r_name, u.r_name) AS r_name FROM u LEFT JOIN m ON u.r_regionkey = m.r_regionkey AND m.r_regionkey = 4"""

QUERIES = [q35_rate_limit_sliding, q36_throttle_tumbling, q37_registry_validation, q38_dedupe_by_host, q39_audit_rows, q40_fallback_rate, q41_context_block, q42_prompt_disclaimer, q43_sse_parse, q44_golden_eval, q45_role_views, q46_fk_cascade, q47_seed_upsert]
SQL = dict(zip([f.__name__ for f in QUERIES], [Q35, Q36, Q37, Q38, f"WITH {_AUDIT} SELECT * FROM audit", f"WITH {_AUDIT} SELECT count(*) FILTER (WHERE was_fallback) AS fallbacks, count(*) AS total FROM audit", Q41, Q42, Q43, Q44, Q45, Q46, Q47], strict=True))
