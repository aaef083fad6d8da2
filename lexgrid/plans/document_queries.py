"""Chunking, store and text queries q17 to q34 with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrid.functions.text import clause_pieces, clean_text, definition_term, token_estimate
from lexgrid.operators.chunking import chunk_clauses
from lexgrid.operators.store import decision, orphans, pending, upsert
from lexgrid.sources.embedding import INPUTS, batch_budget
from lexgrid.sources.tables import CHUNKS_SQL, chunks, table


#: Ids of a stretch, and the tokens of a batch under the default rates.
STRETCH, BUDGET = 9600, batch_budget(100_000, 10_000, 3)


def _marked(text):
    """The driver's prose with clause markers before some of its lines, so that sub-clauses can be cut."""
    return F.regexp_replace(F.regexp_replace(text, r"\n([A-M])", "\n(a) $1"), r"\n([N-Z])", "\n  (iv)  $1")


_MARKED = r"regexp_replace(regexp_replace(text, '\n([A-M])', chr(10) || '(a) \1', 'g'), '\n([N-Z])', chr(10) || '  (iv)  \1', 'g')"
_STRIP = r"regexp_replace({0}, '^[\s\x{{85}}\x{{a0}}]+|[\s\x{{85}}\x{{a0}}]+$', '', 'g')"


def _fold(parts: str, glue: str) -> str:
    """Greedy packing as list_reduce over structs; gives the list of packed strings."""
    start = "{'done': CAST([] AS VARCHAR[]), 'now': ''}"
    over = f"a.now <> '' AND length(a.now) + {1} + length(x.now) > 2400"
    step = f"CASE WHEN {over} THEN {{'done': list_append(a.done, a.now), 'now': x.now}} ELSE {{'done': a.done, 'now': CASE WHEN a.now = '' THEN x.now ELSE a.now || {glue} || x.now END}} END"
    return f"list_reduce(list_prepend({start}, list_transform({parts}, lambda p: {{'done': CAST([] AS VARCHAR[]), 'now': p}})), lambda a, x: {step})"


_SPLIT = rf"""b AS (SELECT doc_id, lang, source, {_STRIP.format(_MARKED)} AS body FROM documents),
blocks AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(body, '\n([^\S\n]*\((?:[a-z]{{1,3}}|[A-Z]{{1,3}}|\d{{1,3}})\)[^\S\n]+\S)', chr(30) || '\1', 'g'), chr(30)), lambda k: {_STRIP.format("k")}), lambda k: k <> '') AS blocks FROM b WHERE length(body) > 2400),
parts AS (
  SELECT doc_id, flatten(list_transform(blocks, lambda k: CASE WHEN length(k) <= 2400 THEN [k] ELSE list_append(({_fold("string_split(regexp_replace(k, '([.;:])" + chr(92) + "s+([A-Z(])', '" + chr(92) + "1' || chr(30) || '" + chr(92) + "2', 'g'), chr(30))", "' '")}).done, ({_fold("string_split(regexp_replace(k, '([.;:])" + chr(92) + "s+([A-Z(])', '" + chr(92) + "1' || chr(30) || '" + chr(92) + "2', 'g'), chr(30))", "' '")}).now) END)) AS parts FROM blocks),
packed AS (SELECT doc_id, {_fold("parts", "chr(10)")} AS p FROM parts),
pieces AS (
  SELECT doc_id, CASE WHEN len(p.done) > 0 AND length(p.now) < 120 THEN list_append(p.done[:-2], p.done[-1] || chr(10) || p.now) ELSE list_append(p.done, p.now) END AS pieces FROM packed
  UNION ALL SELECT doc_id, CASE WHEN body = '' OR body IS NULL THEN CAST([] AS VARCHAR[]) ELSE [body] END FROM b WHERE body IS NULL OR length(body) <= 2400)"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", clause_pieces(_marked(F.col("text"))).alias("pieces"))


def q17_chunk_split(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("doc_id", F.size("pieces").cast("long").alias("n"), F.posexplode("pieces").alias("part", "piece")).select("doc_id", "n", F.col("part").cast("long").alias("part"), F.length("piece").cast("long").alias("chars"), F.sha2("piece", 256).alias("digest"))


Q17 = f"WITH {_SPLIT} SELECT doc_id, len(pieces)::BIGINT AS n, i - 1 AS part, length(pieces[i])::BIGINT AS chars, sha256(pieces[i]) AS digest FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM pieces)"


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    """Documents as clauses: some with a part, a parent, a label, amendments."""
    n, text = F.col("id"), lambda x: F.lit(x).cast("string")
    some = lambda when, value: F.when(when, value)
    c = chunks(spark, d).withColumns({"text": _marked(F.col("chunk_content")), "province_code": F.lit("NB"), "municipality_name": F.col("municipality_id"), "bylaw_name": F.col("language"), "section_title": text(None), "source_url": some(n % 2 == 0, text("https://x/\"a\"")), "document_version": text(None)})
    return c.withColumns({"page_label": some(n % 5 == 0, F.concat(F.lit("8-"), n.cast("string"))), "part_number": some(n % 3 == 0, text("8")), "part_title": some(n % 3 == 0, text("Zones")), "parent_number": some(n % 7 == 0, text("8.1")), "parent_title": some(n % 7 == 0, text("Uses")), "amendments": some(n % 11 == 0, F.array(F.lit("Z-5.1"), F.lit("Z-5.2")))}).drop("chunk_content")


def q18_chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunk contents with their header; chunk_index counts within (tenant, language, section)."""
    made = chunk_clauses(_clauses(spark, d), order=("id",))
    return made.select("id", (F.col("part") - 1).cast("long").alias("part"), F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("chunk_content", 256).alias("fingerprint"))


Q18 = f"""WITH {CHUNKS_SQL}, {_SPLIT}, e AS (SELECT doc_id, len(pieces) AS n, i, pieces[i] AS piece FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM pieces))
SELECT id, i - 1 AS part, row_number() OVER (PARTITION BY municipality_id, language, section_number ORDER BY id, i) - 1 AS chunk_index,
       sha256('[Province: NB] [Municipality: ' || municipality_id || '] [Bylaw: ' || language || ']' || CASE WHEN id % 3 = 0 THEN ' [Part 8: Zones]' ELSE '' END || CASE WHEN id % 7 = 0 THEN ' [8.1 Uses]' ELSE '' END || chr(10) || 'Section ' || section_number || CASE WHEN n > 1 THEN ' (part ' || i || ' of ' || n || ')' ELSE '' END || ':' || chr(10) || piece) AS fingerprint
FROM chunks JOIN e ON id = doc_id"""


def q19_chunk_metadata_json(spark: SparkSession, d: str) -> DataFrame:
    """Metadata as JSON, its nine keys there even if null and others only where they apply, read back by key."""
    made = chunk_clauses(_clauses(spark, d), order=("id",))
    read = lambda key: F.get_json_object("metadata", f"$.{key}").alias(key)
    return made.select("id", F.col("part").cast("long").alias("n"), read("section"), read("page"), read("url"), read("part_title"), read("parent_section"), read("amendments"), read("page_label"), read("chunk_parts"), F.size(F.json_object_keys("metadata")).cast("long").alias("n_keys"))


Q19 = f"""WITH {CHUNKS_SQL}, {_SPLIT}, e AS (SELECT doc_id, len(pieces) AS parts, i FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM pieces))
SELECT id, i AS n, section_number AS section, page_number::VARCHAR AS page, CASE WHEN id % 2 = 0 THEN 'https://x/"a"' END AS url, CASE WHEN id % 3 = 0 THEN 'Zones' END AS part_title, CASE WHEN id % 7 = 0 THEN '8.1' END AS parent_section, CASE WHEN id % 11 = 0 THEN '["Z-5.1","Z-5.2"]' END AS amendments,
  CASE WHEN id % 5 = 0 THEN '8-' || id END AS page_label, CASE WHEN parts > 1 THEN parts::VARCHAR END AS chunk_parts, 9 + 2 * (id % 3 = 0)::BIGINT + 2 * (id % 7 = 0)::BIGINT + (id % 11 = 0)::BIGINT + (id % 5 = 0)::BIGINT + 2 * (parts > 1)::BIGINT AS n_keys FROM chunks JOIN e ON id = doc_id"""


def q20_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("id", F.sha2("chunk_content", 256).alias("fingerprint"))


Q20 = "SELECT doc_id AS id, sha256(text) AS fingerprint FROM documents"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What is stored, without some rows and with some changed, and what is read now, without some others."""
    c = chunks(spark, d).select("id", "municipality_id", F.sha2("chunk_content", 256).alias("hash"))
    return c.where("id % 7 <> 0").withColumn("hash", F.when(F.col("id") % 5 == 0, F.lit("old")).otherwise(F.col("hash"))), c.where("id % 11 <> 0")


_VERSIONS = """o AS (SELECT doc_id AS id, source AS municipality_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id AS id, source AS municipality_id, sha256(text) AS hash FROM documents WHERE doc_id % 11 <> 0)"""


def q21_change_decision(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return new.join(old.select("id", F.col("hash").alias("previous")), "id", "left").select("id", decision(F.col("previous"), F.col("hash"), F.col("id") % 13 == 0).alias("reason"))


Q21 = f"WITH {_VERSIONS} SELECT n.id, CASE WHEN n.id % 13 = 0 THEN 'forced' WHEN o.hash IS NULL THEN 'new' WHEN o.hash <> n.hash THEN 'content_changed' ELSE 'unchanged' END AS reason FROM n LEFT JOIN o ON n.id = o.id"


def q22_upsert_natural_key(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return upsert(old.withColumn("made", F.lit("before")), new.withColumn("made", F.lit("now")), ["id", "municipality_id"], keep=("made",))


Q22 = f"WITH {_VERSIONS} SELECT coalesce(n.id, o.id) AS id, coalesce(n.municipality_id, o.municipality_id) AS municipality_id, coalesce(n.hash, o.hash) AS hash, CASE WHEN o.id IS NULL THEN 'now' ELSE 'before' END AS made FROM o FULL JOIN n ON o.id = n.id AND o.municipality_id = n.municipality_id"


def q23_orphans(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return orphans(old, new, ["municipality_id", "id"])


Q23 = f"WITH {_VERSIONS} SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = o.id AND n.municipality_id = o.municipality_id)"


def q24_resume_pending(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return pending(new, old, ["municipality_id", "id"], "hash")


Q24 = f"WITH {_VERSIONS} SELECT n.* FROM n LEFT JOIN o ON n.id = o.id AND n.municipality_id = o.municipality_id WHERE o.hash IS DISTINCT FROM n.hash"


def q25_source_sniff(spark: SparkSession, d: str) -> DataFrame:
    """Routing of fetched bodies: gone, a document by its signature, a login page, or something else."""
    body = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("%PDF-1.7 "), F.col("html"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("<p>Please Sign In</p>"), F.col("html"))).otherwise(F.col("html"))
    status = F.when(F.col("page_id") % 9 == 0, 410).otherwise(200)
    p = table(spark, d, "pages").select("page_id", body.cast("binary").alias("content"), status.alias("status"))
    kind = F.when(F.col("status").isin(404, 410), "source_gone").when(F.substring("content", 1, 4) == F.lit(b"%PDF"), "document").when(F.lower(F.try_to_binary(F.hex(F.substring("content", 1, 1024)), F.lit("hex")).cast("string")).rlike("login|sign in"), "login_page").otherwise("not_a_document")
    return p.select("page_id", kind.alias("kind"), F.sha2("content", 256).alias("content_hash"))


Q25 = """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '%PDF-1.7 ' || html WHEN 1 THEN '<p>Please Sign In</p>' || html ELSE html END AS c FROM pages)
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'source_gone' WHEN starts_with(c, '%PDF') THEN 'document' WHEN regexp_matches(lower(left(c, 400)), 'login|sign in') THEN 'login_page' ELSE 'not_a_document' END AS kind, sha256(c) AS content_hash FROM p"""


def q26_scheme_health(spark: SparkSession, d: str) -> DataFrame:
    """Per source: clauses, upper median and largest length, how many are oversized, and whether that is healthy.

    The median is exact and needs no list of a group: lengths are counted, and the count's running sum is met.
    """
    sizes = table(spark, d, "documents").groupBy("source", F.length("text").alias("chars")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("source").orderBy("chars")
    whole = Window.partitionBy("source")
    at = sizes.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(whole))
    out = at.groupBy("source").agg(F.max("total").alias("clauses"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("chars"))).cast("long").alias("upper_median"), F.max("chars").cast("long").alias("largest"), F.sum(F.when(F.col("chars") > 12000, F.col("n")).otherwise(0)).alias("oversized"))
    return out.withColumn("healthy", (F.col("oversized") == 0) & (F.col("clauses") > 20))


Q26 = """SELECT source, count(*) AS clauses, list_sort(list(length(text)))[count(*) // 2 + 1]::BIGINT AS upper_median, max(length(text))::BIGINT AS largest, count(*) FILTER (WHERE length(text) > 12000) AS oversized,
count(*) FILTER (WHERE length(text) > 12000) = 0 AND count(*) > 20 AS healthy FROM documents GROUP BY source"""


def q27_mode_min_support(spark: SparkSession, d: str) -> DataFrame:
    """Most common quantised price per supplier with at least two rows; ties to the smaller value."""
    q = (F.bround(F.col("l_extendedprice") / 4000) * 4000).alias("value")
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", q).agg(F.count("*").alias("n"))
    return counts.where("n >= 2").groupBy("l_suppkey").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"), F.max("n").alias("support"))


Q27 = """WITH c AS (SELECT l_suppkey, round_even(l_extendedprice / 4000, 0) * 4000 AS value, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 2)
SELECT l_suppkey, value AS mode, n AS support FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, value) = 1"""


def q28_nearest_column_join(spark: SparkSession, d: str) -> DataFrame:
    """Every part size to the nearest column centre at most 3 away, ties to the left: a join on the cells around each centre."""
    centres = spark.range(0, 6).select((F.col("id") * 9 + 4).cast("int").alias("centre"))
    reach = centres.withColumn("p_size", F.explode(F.sequence(F.col("centre") - 3, F.col("centre") + 3)))
    sizes = table(spark, d, "part").select("p_partkey", "p_size")
    near = sizes.join(F.broadcast(reach), "p_size").withColumn("away", F.abs(F.col("p_size") - F.col("centre")))
    return near.groupBy("p_partkey").agg(F.min_by("centre", F.struct("away", "centre")).alias("centre"), F.min("away").alias("away"))


Q28 = "SELECT p_partkey, c AS centre, abs(p_size - c) AS away FROM part, (SELECT CAST(unnest(range(6)) * 9 + 4 AS INTEGER) AS c) WHERE abs(p_size - c) <= 3 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size - c), c) = 1"


def q29_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase value before or at each event of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("carried"))


Q29 = "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def q30_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """A line opening with T is a heading; it and the lines up to the next one are a segment."""
    flag = F.col("line").startswith("T").cast("int")
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return _lines(spark, d).withColumn("segment", F.sum(flag).over(w)).where("segment > 0").groupBy("doc_id", "segment").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


Q30 = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
s AS (SELECT *, sum(CASE WHEN starts_with(line, 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS segment FROM l)
SELECT doc_id, segment, count(*) AS lines, sum(length(line)) AS chars FROM s WHERE segment > 0 GROUP BY ALL"""


def q31_line_page_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Which classes a page (a document of lines) falls into, by the shares of lines that look like entries."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hits = lambda p, extra=None: F.size(F.filter("lines", lambda x: x.rlike(p) if extra is None else x.rlike(p) & extra(x)))
    n = F.size("lines")
    share = lambda h: F.coalesce(F.try_divide(h.cast("double"), n), F.lit(0.0))
    toc = hits(r"\s\d+\s*[-–]\s*\d+$|\.{4,}\s*\d+\s*$")
    contents = hits(r"(?i)^(?:\d{1,3}(?:\.\d+)?(?:\s?\(\d+\))?\s+\S|Division\s+\d|Section\s+\d|PART(?:IE)?\s+\d|SCHEDULE\s|ANNEXE\s)", lambda x: F.length(x) < 70)
    return table(spark, d, "documents").withColumn("lines", lines).select("doc_id", ((n > 0) & (toc >= F.greatest(F.lit(3), F.floor(n / 3)))).alias("toc"), ((n >= 12) & (share(contents) >= 0.5)).alias("contents"), ((n >= 8) & (share(hits(r"^[A-Z][A-Za-z ,:&/-]{3,60}\s+\d{1,2}$")) >= 0.6)).alias("divider"), ((n >= 12) & (share(hits(r"^[a-zà-ÿ][^–—.]{1,44}[–—][^–—.]{1,44}$")) >= 0.4)).alias("term_index"), F.round(share(hits(r"\.$")), 6).alias("stops"))


Q31 = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
h AS (SELECT doc_id, len(lines) AS n, len(list_filter(lines, lambda x: regexp_matches(x, '\s\d+\s*[-–]\s*\d+$|\.{4,}\s*\d+\s*$'))) AS toc,
  len(list_filter(lines, lambda x: length(x) < 70 AND regexp_matches(x, '(?i)^(?:\d{1,3}(?:\.\d+)?(?:\s?\(\d+\))?\s+\S|Division\s+\d|Section\s+\d|PART(?:IE)?\s+\d|SCHEDULE\s|ANNEXE\s)'))) AS contents,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[A-Z][A-Za-z ,:&/-]{3,60}\s+\d{1,2}$'))) AS divider, len(list_filter(lines, lambda x: regexp_matches(x, '^[a-zà-ÿ][^–—.]{1,44}[–—][^–—.]{1,44}$'))) AS terms, len(list_filter(lines, lambda x: regexp_matches(x, '\.$'))) AS stops FROM l)
SELECT doc_id, n > 0 AND toc >= greatest(3, n // 3) AS toc, n >= 12 AND contents / n >= 0.5 AS contents, n >= 8 AND divider / n >= 0.6 AS divider, n >= 12 AND terms / n >= 0.4 AS term_index, round(CASE WHEN n = 0 THEN 0 ELSE stops / n END, 6) AS stops FROM h"""


def q32_clean_text(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit("  "), F.regexp_replace("text", r"\. ", "  .  "), F.lit("\n\n\n\nend ; "))
    return table(spark, d, "documents").select("doc_id", F.sha2(clean_text(dirty), 256).alias("digest"))


Q32 = r"""WITH t AS (SELECT doc_id, '  ' || regexp_replace(text, '\. ', '  .  ', 'g') || chr(10) || chr(10) || chr(10) || chr(10) || 'end ; ' AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' +([.,;:)])', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM t"""


def q33_definition_term(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a definition: its first word in guillemets, before 'means', or neither."""
    first = F.regexp_extract("text", r"([\p{L}\p{N}]{1,40})", 1)
    form = F.col("doc_id") % 3
    body = F.when(form == 0, F.concat(F.lit("« "), first, F.lit(" » "), F.col("text"))).when(form == 1, F.concat(first, F.lit(" means "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", definition_term(body).alias("term"))


Q33 = r"""WITH f AS (SELECT doc_id, text, regexp_extract(text, '([\p{L}\p{N}]{1,40})', 1) AS first FROM documents),
t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '« ' || first || ' » ' || text WHEN 1 THEN first || ' means ' || text ELSE text END AS b FROM f)
SELECT doc_id, coalesce(nullif(trim(regexp_extract(b, '^[«"“]\s*(.{1,80}?)\s*[»"”]', 1)), ''), nullif(trim(regexp_extract(b, '^(.{1,80}?)\s+means\b', 1)), ''), array_to_string(regexp_split_to_array(trim(b), '\s+')[1:6], ' ')) AS term FROM t"""


def q34_token_batches(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a tenant in slices of 96 in order, and every slice in batches of at most 2833 estimated tokens.

    Slices are numbered within stretches of ids, so that no window holds a tenant; the fold runs inside a row per slice.
    """
    of = Window.partitionBy("municipality_id", "stretch").orderBy("id")
    c = chunks(spark, d).select("municipality_id", F.floor(F.col("id") / STRETCH).alias("stretch"), "id", token_estimate(F.col("chunk_content")).alias("tokens"))
    sliced = c.withColumn("slice", F.floor((F.row_number().over(of) - 1) / INPUTS))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("batches"), F.lit(0).cast("long").alias("most"))

    def add(a, x):
        new = (a["batches"] == 0) | (a["sum"] + x["tokens"] > BUDGET)
        total = F.when(new, x["tokens"]).otherwise(a["sum"] + x["tokens"])
        return F.struct(total.alias("sum"), (a["batches"] + new.cast("long")).alias("batches"), F.greatest(a["most"], total).alias("most"))

    folded = sliced.groupBy("municipality_id", "stretch", "slice").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("id", "tokens"))), start, add).alias("f"), F.sum("tokens").alias("tokens"), F.count("*").alias("inputs"))
    return folded.select("municipality_id", "stretch", "slice", "tokens", "inputs", F.col("f.batches").alias("batches"), F.col("f.most").alias("most"))


Q34 = f"""WITH RECURSIVE n AS (SELECT source AS m, doc_id // {STRETCH} AS st, floor(length(text) / 3.5)::BIGINT + 1 AS t, row_number() OVER (PARTITION BY source, doc_id // {STRETCH} ORDER BY doc_id) - 1 AS i FROM documents),
c AS (SELECT m, st, i // {INPUTS} AS sl, i % {INPUTS} AS i, t FROM n),
r AS (SELECT m, st, sl, i, t AS s, 1::BIGINT AS b, t AS most FROM c WHERE i = 0
  UNION ALL SELECT c.m, c.st, c.sl, c.i, CASE WHEN s + t > {BUDGET} THEN t ELSE s + t END, b + CASE WHEN s + t > {BUDGET} THEN 1 ELSE 0 END, greatest(most, CASE WHEN s + t > {BUDGET} THEN t ELSE s + t END)
  FROM r JOIN c ON c.m = r.m AND c.st = r.st AND c.sl = r.sl AND c.i = r.i + 1),
k AS (SELECT m, st, sl, max(b) AS batches, max(most) AS most FROM r GROUP BY ALL)
SELECT k.m AS municipality_id, k.st AS stretch, k.sl AS slice, sum(t)::BIGINT AS tokens, count(*) AS inputs, batches, most FROM k JOIN c ON c.m = k.m AND c.st = k.st AND c.sl = k.sl GROUP BY ALL"""

QUERIES = [q17_chunk_split, q18_chunk_rows, q19_chunk_metadata_json, q20_fingerprint, q21_change_decision, q22_upsert_natural_key, q23_orphans, q24_resume_pending, q25_source_sniff, q26_scheme_health, q27_mode_min_support, q28_nearest_column_join, q29_carry_forward, q30_segmentation, q31_line_page_classifier, q32_clean_text, q33_definition_term, q34_token_batches]
SQL = dict(zip([f.__name__ for f in QUERIES], [Q17, Q18, Q19, Q20, Q21, Q22, Q23, Q24, Q25, Q26, Q27, Q28, Q29, Q30, Q31, Q32, Q33, Q34], strict=True))
