"""Queries q58 to q66: runs over sources, answers as events, readiness, embedding, the layout and migration of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions.answer import FALLBACK, UNVERIFIED, frames
from lexgrid.operators.answering import CUT_SHORT, FAILURE, bodies, events, readiness
from lexgrid.operators.ingest import HEAD, ROW, WIDTH, outcome, selected, summary
from lexgrid.operators.store import replace_table, without_vectors
from lexgrid.session import ship
from lexgrid.sources.embedding import embed_documents, hashed
from lexgrid.sources.tables import CHUNKS_SQL, chunks, table
from lexgrid.streaming.streams import shared_folder


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as fetched sources whose facts follow from their ids."""
    n = F.col("doc_id")
    status = F.when(n % 17 == 0, 404).when(n % 19 == 0, 500).otherwise(200)
    current = F.sha2("text", 256)
    previous = F.when(n % 3 == 1, current).when(n % 3 == 2, F.lit("old"))
    how = outcome(status, F.when(n % 23 == 0, F.lit("timeout")), n % 5 != 0, previous, current, n % 7 == 0, n % 60 + 10 * (n % 2), F.when(n % 11 == 0, 1).otherwise(0), n % 13 == 0, n % 6, n % 9)
    return table(spark, d, "documents").select(F.concat(F.lit("m"), n.cast("string")).alias("id"), F.col("lang").alias("language"), how.alias("status"), (n % 60).alias("clauses"), (n % 90).alias("chunks"), (n % 8).alias("upserted"), (n % 4).alias("deleted"), F.when(n % 17 == 0, F.lit("gone")).alias("detail"))


_OUTCOMES = f"""o AS (SELECT 'm' || doc_id AS id, lang AS language, CASE WHEN doc_id % 17 = 0 THEN 'source_gone' WHEN doc_id % 23 = 0 OR doc_id % 19 = 0 THEN 'error' WHEN doc_id % 5 = 0 THEN 'not_a_document'
  WHEN doc_id % 7 <> 0 AND doc_id % 3 = 1 THEN 'unchanged' WHEN doc_id % 60 + 10 * (doc_id % 2) = 0 THEN 'no_clauses' WHEN doc_id % 7 <> 0 AND (doc_id % 11 = 0 OR doc_id % 60 + 10 * (doc_id % 2) <= 20) THEN 'unhealthy_parse'
  WHEN doc_id % 13 = 0 THEN 'dry_run' WHEN doc_id % 9 < doc_id % 6 THEN 'quota_exhausted' WHEN doc_id % 7 = 0 THEN 'forced' WHEN doc_id % 3 = 0 THEN 'new' ELSE 'content_changed' END AS status,
  doc_id % 60 AS clauses, doc_id % 90 AS chunks, doc_id % 8 AS upserted, doc_id % 4 AS deleted, CASE WHEN doc_id % 17 = 0 THEN 'gone' END AS detail FROM documents)"""


def q58_ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d)


Q58 = f"WITH {_OUTCOMES} SELECT * FROM o"


def q59_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(_outcomes(spark, d))


_TOP = ", ".join(f"({i}, '{line}')" for i, line in enumerate(["", "=" * WIDTH, "INGESTION SUMMARY", "=" * WIDTH, ROW % HEAD, "-" * WIDTH]))
Q59 = f"""WITH {_OUTCOMES}, t AS (SELECT count(*) || ' source(s): ' || sum(upserted) || ' chunks written, ' || count(*) FILTER (WHERE status = 'unchanged') || ' unchanged, ' || count(*) FILTER (WHERE status IN ('error', 'source_gone', 'not_a_document')) || ' failed' AS line FROM o)
SELECT 0 AS block, NULL::VARCHAR AS id, NULL::VARCHAR AS language, NULL::VARCHAR AS status, NULL::VARCHAR AS detail, k, line FROM (VALUES {_TOP}) t(k, line)
UNION ALL SELECT 1, id, language, status, detail, 0, printf('{ROW}', id, language, status, clauses::VARCHAR, chunks::VARCHAR, upserted::VARCHAR, deleted::VARCHAR) FROM o
UNION ALL SELECT 1, id, language, status, detail, 1, '    -> ' || detail FROM o WHERE detail IS NOT NULL
UNION ALL SELECT 2, NULL, NULL, NULL, NULL, 0, '{"=" * WIDTH}' UNION ALL SELECT 2, NULL, NULL, NULL, NULL, 1, line FROM t"""


def q60_source_selection(spark: SparkSession, d: str) -> DataFrame:
    """Nations as registry entries, their customers' segments as languages and documents, some of them shared."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.struct(F.substring("c_mktsegment", 1, 2).alias("language"), F.col("c_mktsegment").alias("bylaw_name"), F.concat(F.lit("u"), (F.length("c_mktsegment") % 3).cast("string")).alias("source_url")).alias("s"))
    listed = c.groupBy("k").agg(F.sort_array(F.collect_set("s")).alias("sources"))
    k = F.col("n_nationkey")
    registry = table(spark, d, "nation").join(listed, k == F.col("k"), "left").select(F.col("n_name").alias("id"), (k % 4 != 0).alias("is_active"), F.lit("x").alias("status"), (k % 5 == 0).alias("interleaved"), F.when(k % 3 != 0, F.col("sources")).alias("sources"), F.when(k % 6 == 0, F.lit("own")).alias("source_url"), F.array(F.lit("fr")).alias("languages"), F.col("n_name").alias("source_bylaw_name"))
    return selected(registry).select("id", "language", "bylaw_name", "source_url", F.array_join("also_languages", ",").alias("also"), "status")


Q60 = """WITH s AS (SELECT DISTINCT c_nationkey AS k, left(c_mktsegment, 2) AS language, c_mktsegment AS bylaw_name, 'u' || (length(c_mktsegment) % 3) AS source_url FROM customer),
e AS (SELECT n_name AS id, n_nationkey AS k FROM nation WHERE n_nationkey % 4 <> 0),
l AS (SELECT id, e.k, language, bylaw_name, source_url FROM e JOIN s ON e.k = s.k WHERE e.k % 3 <> 0 UNION ALL SELECT id, k, 'fr', id, 'own' FROM e WHERE k % 6 = 0),
g AS (SELECT id, source_url, CASE WHEN k % 5 = 0 THEN language || bylaw_name END AS apart, list({'l': language, 'b': bylaw_name} ORDER BY language, bylaw_name) AS a FROM l GROUP BY ALL)
SELECT id, a[1].l AS language, a[1].b AS bylaw_name, source_url, array_to_string(list_transform(a[2:], lambda x: x.l), ',') AS also, NULL::VARCHAR AS status FROM g
UNION ALL SELECT id, NULL, NULL, NULL, '', 'no_source' FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = e.id)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Turns as answers: their words are the tokens, and their ids say what was found and how it went."""
    r = F.col("conv_id") * 100 + F.col("turn")
    cited = F.transform(F.sequence(F.lit(1), r % 3 + 1), lambda i: F.concat(F.lit("Section "), i.cast("string")))
    return table(spark, d, "conversations").select(r.alias("request"), F.when(r % 2 == 0, "en").otherwise("fr").alias("language"), F.lit(None).cast("date").alias("verified_on"), F.when(r % 7 != 0, F.slice(cited, F.lit(1), (r % 4).cast("int"))).alias("citations"), F.split(F.coalesce("text", F.lit("")), " ").alias("tokens"), F.when(r % 5 == 0, "length").otherwise("stop").alias("finish"), (r % 11 == 0).alias("failed"))


def q61_answer_events(spark: SparkSession, d: str) -> DataFrame:
    return events(_requests(spark, d)).select("request", F.col("seq").cast("long").alias("seq"), "type", F.sha2("data", 256).alias("digest"))


def _said(texts: dict[str, str]) -> str:
    quote = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"CASE WHEN language = 'fr' THEN {quote(texts['fr'])} ELSE {quote(texts['en'])} END"


_EVENTS = f"""r AS (SELECT conv_id * 100 + turn AS r, CASE WHEN (conv_id * 100 + turn) % 2 = 0 THEN 'en' ELSE 'fr' END AS language, string_split(coalesce(text, ''), ' ') AS t FROM conversations),
p AS (SELECT *, least(r % 3 + 1, r % 4) AS found, r % 7 = 0 AS unfound, r % 7 = 0 OR r % 11 = 0 AS failed, list_filter(t, lambda x: x <> '') AS spoken FROM r),
e AS (SELECT r, CASE WHEN unfound THEN [] ELSE [{{'type': 'citations', 'data': '[' || array_to_string(list_transform(range(1, found + 1), lambda i: '"Section ' || i || '"'), ',') || ']'}}]
  || list_transform(CASE WHEN failed THEN t WHEN found = 0 THEN [{_said(FALLBACK)}, {_said(UNVERIFIED)}]
    ELSE spoken || CASE WHEN r % 5 = 0 THEN [{_said(CUT_SHORT)}] ELSE [] END || [{_said(UNVERIFIED)}] END, lambda x: {{'type': 'token', 'data': x}}) END
  || CASE WHEN failed THEN [{{'type': 'error', 'data': '{FAILURE}'}}] ELSE [{{'type': 'done', 'data': NULL}}] END AS e FROM p)"""
Q61 = f"""WITH {_EVENTS}, u AS (SELECT r, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS seq FROM e)
SELECT r AS request, seq::BIGINT AS seq, x.type AS type, sha256(x.data) AS digest FROM u"""


def q62_answer_frames(spark: SparkSession, d: str) -> DataFrame:
    """Answers written as frames and read back: the events of every kind, and the characters of the tokens."""
    read = bodies(events(_requests(spark, d))).select("request", F.explode(frames(F.col("body"))).alias("e"))
    token = F.when(F.col("e.event") == "token", F.length(F.get_json_object("e.data", "$.data"))).otherwise(0)
    return read.groupBy("request", F.col("e.event").alias("type")).agg(F.count("*").alias("n"), F.sum(token).alias("chars"))


Q62 = f"""WITH {_EVENTS}, u AS (SELECT r, unnest(e) AS x FROM e)
SELECT r AS request, x.type AS type, count(*) AS n, sum(CASE WHEN x.type = 'token' THEN length(x.data) ELSE 0 END)::BIGINT AS chars FROM u GROUP BY ALL"""


def q63_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Events as probes of dependencies by day and user; both depths."""
    found = table(spark, d, "events").select(F.col("user_id").alias("probe"), F.when(F.col("event_id") % 3 == 0, "store").otherwise("key").alias("name"), (F.col("event_id") % 31 != 0).alias("ok"))
    return readiness(found, deep=True).withColumn("deep", F.lit(True)).unionByName(readiness(found).withColumn("deep", F.lit(False)))


Q63 = """WITH p AS (SELECT user_id AS probe, event_id % 3 = 0 AS store, event_id % 31 <> 0 AS ok FROM events), g AS (SELECT probe, bool_and(ok) AS every, coalesce(bool_and(ok) FILTER (WHERE store), false) AS store FROM p GROUP BY 1)
SELECT probe, CASE WHEN every THEN 'ok' ELSE 'degraded' END AS status, CASE WHEN every THEN 200 ELSE 503 END::INTEGER AS http_status, true AS deep FROM g
UNION ALL SELECT probe, CASE WHEN every THEN 'ok' ELSE 'degraded' END, CASE WHEN store THEN 200 ELSE 503 END::INTEGER, false FROM g"""


def _provider():
    return hashed(64)


def q64_embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of whole documents: how many have one, and that they are of unit length."""
    ship(spark)
    rows = embed_documents(table(spark, d, "documents").select("lang", "text"), "text", _provider, 64, blank="null", long="parts")
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"), F.count_if(norm == 1).alias("unit"))


Q64 = "SELECT lang, count(*) AS n, count(*) FILTER (WHERE trim(text, E' \\n\\t\\r') <> '') AS embedded, count(*) FILTER (WHERE trim(text, E' \\n\\t\\r') <> '') AS unit FROM documents GROUP BY 1"


def q65_store_layout(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written by tenant and language, sorted by section, and read back for one of each."""
    rows = chunks(spark, d)
    path = replace_table(spark, rows, f"{shared_folder(spark)}/store", ["id"], ("municipality_id", "language"), ("section_number",))
    read = spark.read.schema(rows.schema).parquet(path)
    return read.where((F.col("municipality_id") == "src3") & (F.col("language") == "en") & F.col("section_number").between("2", "7")).select("id", "section_number", F.sha2("chunk_content", 256).alias("digest"))


Q65 = f"WITH {CHUNKS_SQL} SELECT id, section_number, sha256(chunk_content) AS digest FROM chunks WHERE municipality_id = 'src3' AND language = 'en' AND section_number BETWEEN '2' AND '7'"


def q66_width_migration(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and sources after a change of width: everything is there, nothing is embedded or known as ingested."""
    rows = chunks(spark, d, vectors=True)
    sources = rows.groupBy("municipality_id").agg(F.sha2(F.max("chunk_content"), 256).alias("content_hash"))
    cleared, known = without_vectors(rows, sources)
    counted = cleared.groupBy("municipality_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    hashes = known.groupBy("municipality_id").agg(F.count("content_hash").alias("ingested"))
    return counted.join(hashes.withColumnRenamed("municipality_id", "m"), F.col("municipality_id").eqNullSafe(F.col("m"))).drop("m")


Q66 = "SELECT source AS municipality_id, count(*) AS chunks, 0::BIGINT AS embedded, 0::BIGINT AS ingested FROM documents GROUP BY 1"

QUERIES = [q58_ingest_outcomes, q59_run_summary, q60_source_selection, q61_answer_events, q62_answer_frames, q63_readiness, q64_embed_documents, q65_store_layout, q66_width_migration]
SQL = dict(zip([f.__name__ for f in QUERIES], [Q58, Q59, Q60, Q61, Q62, Q63, Q64, Q65, Q66], strict=True))
