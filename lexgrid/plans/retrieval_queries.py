"""Retrieval queries q01 to q16 with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions.lexemes import squashed, text_rank
from lexgrid.functions.text import names_section, section_hint, similarity, trigrams
from lexgrid.functions.vector import cosine
from lexgrid.operators.hybrid import retrieve, retrieve_for_each
from lexgrid.operators.retrieval import fuse, keyword_search, match, ranked, scoped
from lexgrid.session import ship
from lexgrid.sources.embedding import Refused
from lexgrid.sources.tables import CHUNKS_SQL, chunks, table

QUESTION = "what does section 8.3 say about the setbacks of the and that"
WEB_QUESTION = 'reing thing or "attion" -blend or erble that'
TENANT, LANGUAGE = "src3", "en"


def _vector(spark: SparkSession, d: str, vec_id: int = 3) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


_COS = "list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
_GRAMS = "list_distinct(flatten(list_transform(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: '  ' || w || ' '), lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))))"
_SIM = "(len(list_intersect(t.a, t.b))::DOUBLE / greatest(1, len(t.a) + len(t.b) - len(list_intersect(t.a, t.b))))"


def q01_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = match(chunks(spark, d, vectors=True), _vector(spark, d), TENANT)
    return hits.select("id", "section_number", "page_number", F.round("similarity", 6).alias("similarity"), F.format_string("[%s - %s, Section %s]", "municipality_id", "language", "section_number").alias("citation"))


Q01 = f"""WITH {CHUNKS_SQL}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 3),
s AS (SELECT c.*, {_COS} AS sim FROM chunks c, q WHERE c.municipality_id = '{TENANT}' AND c.embedding IS NOT NULL)
SELECT id, section_number, page_number, round(sim, 6) AS similarity, '[' || municipality_id || ' - ' || language || ', Section ' || section_number || ']' AS citation
FROM s WHERE sim > 0.3 ORDER BY sim DESC, id LIMIT 5"""


def q02_vector_threshold_counts(spark: SparkSession, d: str) -> DataFrame:
    sim = table(spark, d, "embeddings").withColumn("s", cosine(F.col("embedding"), F.lit(_vector(spark, d))))
    return sim.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("s") > 0.3).alias("near"), F.round(F.max("s"), 6).alias("best"))


Q02 = f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 3), s AS (SELECT c.label, {_COS} AS s FROM embeddings c, q)
SELECT label, count(*) AS n, count(*) FILTER (WHERE s > 0.3) AS near, round(max(s), 6) AS best FROM s GROUP BY label"""


def q03_section_exact_prefix(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("section_number")
    return chunks(spark, d).where(names_section(s, F.lit("4.3"))).select("id", "section_number", F.when(s == "4.3", 1.0).otherwise(0.9).alias("score"))


Q03 = f"""WITH {CHUNKS_SQL} SELECT id, section_number, CASE WHEN section_number = '4.3' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS score FROM chunks
WHERE starts_with(section_number, '4.3') AND NOT regexp_matches(substr(section_number, 4, 1), '[0-9]')"""


def q04_trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    sim = similarity(trigrams(F.col("chunk_content")), trigrams(F.lit(QUESTION)))
    return chunks(spark, d).select("id", F.round(sim, 6).alias("similarity"), (sim >= 0.3).alias("matches"))


Q04 = f"""WITH t AS (SELECT doc_id AS id, {_GRAMS.format("text")} AS a, {_GRAMS.format(f"'{QUESTION}'")} AS b FROM documents)
SELECT id, round({_SIM}, 6) AS similarity, {_SIM} >= 0.3 AS matches FROM t"""


def q05_keyword_tiers_nofts(spark: SparkSession, d: str) -> DataFrame:
    return keyword_search(chunks(spark, d), QUESTION, TENANT, hint="8.3", count=20).select("id", "section_number", F.round("rank", 6).alias("rank"))


Q05 = f"""WITH {CHUNKS_SQL}, t AS (SELECT *, {_GRAMS.format("chunk_content")} AS a, {_GRAMS.format(f"'{QUESTION}'")} AS b FROM chunks WHERE municipality_id = '{TENANT}'),
tiers AS (
  SELECT id, section_number, 1.0::DOUBLE AS score FROM t WHERE section_number = '8.3'
  UNION ALL SELECT id, section_number, 0.9 FROM t WHERE starts_with(section_number, '8.3') AND section_number <> '8.3' AND NOT regexp_matches(substr(section_number, 4, 1), '[0-9]')
  UNION ALL SELECT id, section_number, 0.5 * {_SIM} FROM t WHERE {_SIM} >= 0.3)
SELECT id, section_number, round(max(score), 6) AS rank FROM tiers GROUP BY id, section_number ORDER BY max(score) DESC, section_number, id LIMIT 20"""


def q06_fulltext_simple_match(spark: SparkSession, d: str) -> DataFrame:
    """Words 'the' and 'of', not 'idiot', and the phrase 'and the', in the simple configuration."""
    words = F.regexp_extract_all(F.lower("chunk_content"), F.lit(r"[\p{L}\p{N}]+"), 0)
    has = lambda w: F.array_contains("words", w)
    phrase = F.contains(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), F.lit(" and the "))
    return chunks(spark, d).withColumn("words", words).where(has("the") & has("of") & ~has("idiot")).select("id", phrase.alias("phrase"), F.size("words").cast("long").alias("n_words"))


Q06 = """WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM documents)
SELECT id, contains(' ' || array_to_string(words, ' ') || ' ', ' and the ') AS phrase, len(words)::BIGINT AS n_words FROM t
WHERE list_contains(words, 'the') AND list_contains(words, 'of') AND NOT list_contains(words, 'idiot')"""


def q07_fulltext_stemmed_rank(spark: SparkSession, d: str) -> DataFrame:
    """Cover density over stems, titles above bodies: a title is what stands before the first full stop, if short."""
    ship(spark)
    title = F.nullif(F.regexp_extract("chunk_content", r"^([^.\n]{1,60})\.", 1), F.lit(""))
    rank = text_rank(title, F.col("chunk_content"), WEB_QUESTION)
    hits = chunks(spark, d).where(F.col("language") == LANGUAGE).withColumn("rank", rank).where(F.col("rank").isNotNull())
    return hits.select("id", F.round("rank", 6).alias("rank"), F.round(squashed(F.col("rank")), 6).alias("score"))


def q55_keyword_all_tiers(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return keyword_search(chunks(spark, d), WEB_QUESTION, TENANT, LANGUAGE, hint="8.3", count=20, full_text=True).select("id", "section_number", F.round("rank", 6).alias("rank"))


def q08_section_hint(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "conversations").where(F.col("role") == "user")
    forms = F.array(F.lit("see 6.3(1)(a) there"), F.lit("part 4.2.1 and 5.1"), F.lit("in Section 7 and"), F.lit("ARTICLES 12"), F.lit("must be 3 metres"), F.lit("at 8.14"))
    question = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(forms, (F.col("conv_id") % 6 + 1).cast("int")))
    return asked.select("conv_id", "turn", section_hint(question).alias("hint"))


def _hint_sql(q: str) -> str:
    from lexgrid.functions.text import SECTION_PATTERNS

    return "coalesce(" + ", ".join(f"nullif(regexp_extract({q}, '{p}', 1), '')" for p in SECTION_PATTERNS) + ")"


Q08 = f"""WITH q AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || ['see 6.3(1)(a) there', 'part 4.2.1 and 5.1', 'in Section 7 and', 'ARTICLES 12', 'must be 3 metres', 'at 8.14'][conv_id % 6 + 1] AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {_hint_sql("t")} AS hint FROM q"""


def q09_optional_language_filter(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return scoped(c, TENANT).groupBy("language").agg(F.count("*").alias("n")).withColumn("filtered", F.lit(False)).unionByName(scoped(c, TENANT, LANGUAGE).groupBy("language").agg(F.count("*").alias("n")).withColumn("filtered", F.lit(True)))


Q09 = f"""SELECT lang AS language, count(*) AS n, false AS filtered FROM documents WHERE source = '{TENANT}' GROUP BY lang
UNION ALL SELECT lang, count(*), true FROM documents WHERE source = '{TENANT}' AND lang = '{LANGUAGE}' GROUP BY lang"""


def q10_tenant_isolation_check(spark: SparkSession, d: str) -> DataFrame:
    """Hits of two tenants and languages by what they belong to: nothing but the tenant and language that were asked for."""
    parts = [keyword_search(chunks(spark, d), QUESTION, t, x, "8.3", 50).select(F.lit(f"{t} {x}").alias("asked"), F.concat_ws(" ", "municipality_id", "language").alias("given")) for t, x in ((TENANT, LANGUAGE), ("src4", "fr"))]
    return parts[0].unionByName(parts[1]).groupBy("asked", "given").agg(F.count("*").alias("hits"))


Q10 = f"""WITH {CHUNKS_SQL}, t AS (SELECT *, {_GRAMS.format("chunk_content")} AS a, {_GRAMS.format(f"'{QUESTION}'")} AS b FROM chunks),
h AS (SELECT municipality_id || ' ' || language AS given, count(*) AS n FROM t WHERE (municipality_id, language) IN (('{TENANT}', '{LANGUAGE}'), ('src4', 'fr')) AND ((starts_with(section_number, '8.3') AND NOT regexp_matches(substr(section_number, 4, 1), '[0-9]')) OR {_SIM} >= 0.3) GROUP BY 1)
SELECT given AS asked, given, least(50, n) AS hits FROM h"""


def q11_citation_join(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the name of their municipality (a nation by number) and its province, falling back to codes."""
    c = chunks(spark, d).withColumn("key", F.col("id") % 30)
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    joined = c.join(F.broadcast(n), c["key"] == n["n_nationkey"], "left").join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left")
    name = F.coalesce(F.nullif(F.col("n_name"), F.lit("")), F.col("municipality_id"))
    return joined.select("id", F.coalesce("r_name", F.lit("unknown")).alias("province"), F.format_string("[%s - Bylaw, Section %s]", name, F.col("section_number")).alias("citation"))


Q11 = f"""WITH {CHUNKS_SQL} SELECT id, coalesce(r_name, 'unknown') AS province, '[' || coalesce(nullif(n_name, ''), municipality_id) || ' - Bylaw, Section ' || section_number || ']' AS citation
FROM chunks LEFT JOIN nation ON id % 30 = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""


def _lists(spark: SparkSession, d: str, hint: str = "8.3") -> DataFrame:
    c = chunks(spark, d, vectors=True)
    vector = match(c, _vector(spark, d), TENANT, threshold=-1.0, count=20)
    words = keyword_search(c, QUESTION, TENANT, hint=hint, count=20)
    return ranked(vector, 0, [F.col("similarity").desc(), F.col("id")], limit=20).unionByName(ranked(words, 1, [F.col("rank").desc(), F.col("section_number"), F.col("id")], limit=20))


def _fused(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("score", "similarity", "rank") else c for c in df.columns])


def _rrf_sql(w0: float, w1: float, limit: int) -> str:
    return f"""WITH {CHUNKS_SQL}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 3),
v AS (SELECT c.id, {_COS} AS similarity FROM chunks c, q WHERE c.municipality_id = '{TENANT}' AND c.embedding IS NOT NULL),
vl AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS position FROM v QUALIFY position <= 20),
t AS (SELECT *, {_GRAMS.format("chunk_content")} AS a, {_GRAMS.format(f"'{QUESTION}'")} AS b FROM chunks WHERE municipality_id = '{TENANT}'),
k AS (SELECT id, section_number, greatest(CASE WHEN section_number = '8.3' THEN 1.0::DOUBLE END, CASE WHEN starts_with(section_number, '8.3') AND section_number <> '8.3' AND NOT regexp_matches(substr(section_number, 4, 1), '[0-9]') THEN 0.9 END, CASE WHEN {_SIM} >= 0.3 THEN 0.5 * {_SIM} END) AS rank FROM t),
kl AS (SELECT id, rank, row_number() OVER (ORDER BY rank DESC, section_number, id) AS position FROM k WHERE rank IS NOT NULL QUALIFY position <= 20),
f AS (
  SELECT coalesce(vl.id, kl.id) AS id, coalesce({w0}::DOUBLE / (60 + vl.position), 0) + coalesce({w1}::DOUBLE / (60 + kl.position), 0) AS score, similarity, rank,
         coalesce(vl.position, 1000 + kl.position) AS seen, vl.id IS NOT NULL AS inv, round(coalesce(rank, 0), 12) > round(coalesce(similarity, 0), 12) AS stronger,
         round(greatest(coalesce(similarity, 0), coalesce(rank, 0)), 12) AS raw FROM vl FULL JOIN kl ON vl.id = kl.id)
SELECT id, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, raw DESC, seen) AS INTEGER) AS fused_rank, round(score, 6) AS score, round(similarity, 6) AS similarity,
       round(CASE WHEN inv AND NOT stronger THEN NULL ELSE rank END, 6) AS rank FROM f QUALIFY fused_rank <= {limit}"""


def q12_rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fuse(_lists(spark, d)).where("fused_rank <= 10"))


def q13_rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fuse(_lists(spark, d), {0: 10.0, 1: 1.0}).where("fused_rank <= 10"))


def q14_rrf_duplicate_merge(spark: SparkSession, d: str) -> DataFrame:
    """All fused rows: which signals survive when both lists hold an id."""
    return _fused(fuse(_lists(spark, d)))


def _batch_sql(questions: str) -> str:
    """Every question against the chunks of its tenant and language, pair by pair: vector and keyword lists of five, fused."""
    return f"""WITH {CHUNKS_SQL}, q AS ({questions}),
v0 AS (SELECT q.q, c.id, {_COS} AS sim FROM q JOIN chunks c ON c.municipality_id = q.municipality_id AND c.language = q.language WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL),
v AS (SELECT q, id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS p FROM v0 WHERE sim > 0.3 QUALIFY p <= 5),
qa AS (SELECT *, {_hint_sql("question")} AS hint, {_GRAMS.format("question")} AS b FROM q),
ca AS (SELECT id, section_number, municipality_id, language, {_GRAMS.format("chunk_content")} AS a FROM chunks),
t AS (SELECT qa.q, id, section_number, hint, a, b FROM qa JOIN ca ON ca.municipality_id = qa.municipality_id AND ca.language = qa.language),
k0 AS (SELECT q, id, section_number, greatest(CASE WHEN section_number = hint THEN 1.0::DOUBLE END, CASE WHEN starts_with(section_number, hint) AND section_number <> hint AND NOT regexp_matches(substr(section_number, length(hint) + 1, 1), '[0-9]') THEN 0.9 END, CASE WHEN {_SIM} >= 0.3 THEN 0.5 * {_SIM} END) AS rank FROM t),
k AS (SELECT q, id, rank, row_number() OVER (PARTITION BY q ORDER BY rank DESC, section_number, id) AS p FROM k0 WHERE rank IS NOT NULL QUALIFY p <= 5),
f AS (
  SELECT coalesce(v.q, k.q) AS q, coalesce(v.id, k.id) AS id, coalesce(1 / (60.0::DOUBLE + v.p), 0) + coalesce(1 / (60.0::DOUBLE + k.p), 0) AS score, sim AS similarity, rank, coalesce(v.p, 1000 + k.p) AS seen,
         v.id IS NOT NULL AS inv, round(coalesce(rank, 0), 12) > round(coalesce(sim, 0), 12) AS stronger, round(greatest(coalesce(sim, 0), coalesce(rank, 0)), 12) AS raw FROM v FULL JOIN k ON v.q = k.q AND v.id = k.id),
r AS (SELECT q, id, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, raw DESC, seen) AS INTEGER) AS fused_rank, round(score, 6) AS score, round(similarity, 6) AS similarity, round(CASE WHEN inv AND NOT stronger THEN NULL ELSE rank END, 6) AS rank FROM f QUALIFY fused_rank <= 10)"""


def q15_hybrid_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn asks its own tenant by section, text and vector, fused per question; those without a vector are degraded."""
    ship(spark)
    c = table(spark, d, "conversations").where("role = 'user'")
    n = F.col("conv_id")
    asked = c.select((n * 100 + F.col("turn")).alias("q"), F.concat(F.lit("src"), (n % 20).cast("string")).alias("municipality_id"), F.lit(LANGUAGE).alias("language"), F.concat(F.coalesce("text", F.lit("")), F.lit(" section "), (n % 12 + 1).cast("string"), F.lit("."), (n % 40).cast("string")).alias("question"), (n * 3 + F.col("turn")).alias("vec_id"))
    asked = asked.join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")
    return _fused(retrieve_for_each(asked, chunks(spark, d), vectors=chunks(spark, d, vectors=True)))


Q15 = _batch_sql(f"SELECT conv_id * 100 + turn AS q, 'src' || (conv_id % 20) AS municipality_id, '{LANGUAGE}' AS language, coalesce(text, '') || ' section ' || (conv_id % 12 + 1) || '.' || (conv_id % 40) AS question, e.embedding FROM conversations LEFT JOIN embeddings e ON e.vec_id = conv_id * 3 + turn WHERE role = 'user'") + " SELECT r.*, q.embedding IS NULL AS degraded FROM r JOIN q ON r.q = q.q"


def golden_questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as questions of eight suites: each names a section and expects it, and some expect a text or, in a place that is not there, nothing."""
    n = F.col("item_id")
    section = F.concat((n % 12 + 1).cast("string"), F.lit("."), (n % 40).cast("string"))
    nowhere = n % 11 == 0
    items = table(spark, d, "benchmark").select(n.alias("q"), F.concat(F.lit("s"), (n % 8).cast("string")).alias("suite"), F.when(nowhere, "nowhere").otherwise(F.concat(F.lit("src"), (n % 20).cast("string"))).alias("municipality_id"), F.lit(LANGUAGE).alias("language"), F.concat(F.col("text"), F.lit(" section "), section).alias("question"), F.array(section, F.concat(section, F.lit("(1)"))).alias("expect_sections"), F.when(n % 5 == 0, F.array(F.left("text", F.lit(40)))).alias("expect_text"), F.when(n % 7 == 0, "all").otherwise("any").alias("match"), nowhere.alias("expect_fallback"))
    return items.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("q"), "embedding"), "q", "left")


GOLDEN_SQL = _batch_sql(f"SELECT item_id AS q, 's' || (item_id % 8) AS suite, CASE WHEN item_id % 11 = 0 THEN 'nowhere' ELSE 'src' || (item_id % 20) END AS municipality_id, '{LANGUAGE}' AS language, text || ' section ' || (item_id % 12 + 1) || '.' || (item_id % 40) AS question, [(item_id % 12 + 1) || '.' || (item_id % 40), (item_id % 12 + 1) || '.' || (item_id % 40) || '(1)'] AS expect_sections, CASE WHEN item_id % 5 = 0 THEN [left(text, 40)] ELSE [] END AS expect_text, CASE WHEN item_id % 7 = 0 THEN 'all' ELSE 'any' END AS match, item_id % 11 = 0 AS expect_fallback, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id")


def _spent(texts: list[str], kind: str) -> list[tuple[int, list[float]]]:
    raise Refused(402, "quota")


def q16_hybrid_degraded(spark: SparkSession, d: str) -> DataFrame:
    """A provider that refuses: the keyword list alone is fused, and the answer says why."""
    ship(spark)
    found = retrieve(chunks(spark, d, vectors=True), QUESTION, TENANT, _spent, LANGUAGE, width=64)
    return _fused(found.chunks).select("id", "fused_rank", "score", F.lit(found.degraded).alias("degraded"), F.lit(found.reason).alias("reason"))


_ONE = f"SELECT 1 AS q, '{TENANT}' AS municipality_id, '{LANGUAGE}' AS language, '{QUESTION}' AS question, "
Q16 = _batch_sql(_ONE + "NULL::FLOAT[] AS embedding") + " SELECT id, fused_rank, score, true AS degraded, 'QuotaExhausted: 402: quota' AS reason FROM r"


def q67_hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """One question by both ways, with a provider that gives a stored vector."""
    ship(spark)
    vector = _vector(spark, d)
    found = retrieve(chunks(spark, d, vectors=True), QUESTION, TENANT, lambda texts, kind: [(0, vector)], LANGUAGE, width=64)
    return _fused(found.chunks).withColumn("degraded", F.lit(found.degraded))


Q67 = _batch_sql(_ONE + "(SELECT embedding FROM embeddings WHERE vec_id = 3) AS embedding") + " SELECT id, fused_rank, score, similarity, rank, false AS degraded FROM r"

SQL = {"q01_vector_topk": Q01, "q02_vector_threshold_counts": Q02, "q03_section_exact_prefix": Q03, "q04_trigram_similarity": Q04, "q05_keyword_tiers_nofts": Q05, "q06_fulltext_simple_match": Q06, "q08_section_hint": Q08, "q09_optional_language_filter": Q09, "q10_tenant_isolation_check": Q10, "q11_citation_join": Q11, "q12_rrf_two_lists": _rrf_sql(1, 1, 10), "q13_rrf_weighted": _rrf_sql(10, 1, 10), "q14_rrf_duplicate_merge": _rrf_sql(1, 1, 1000), "q15_hybrid_batch_topk": Q15, "q16_hybrid_degraded": Q16, "q67_hybrid_retrieve": Q67}
QUERIES = [q07_fulltext_stemmed_rank, q55_keyword_all_tiers, q01_vector_topk, q02_vector_threshold_counts, q03_section_exact_prefix, q04_trigram_similarity, q05_keyword_tiers_nofts, q06_fulltext_simple_match, q08_section_hint, q09_optional_language_filter, q10_tenant_isolation_check, q11_citation_join, q12_rrf_two_lists, q13_rrf_weighted, q14_rrf_duplicate_merge, q15_hybrid_batch_topk, q16_hybrid_degraded, q67_hybrid_retrieve]
