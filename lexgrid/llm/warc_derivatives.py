"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A response is a row (target_uri, warc_date, payload, ...). Both derivatives refer to it by its record id,
repeat its target and date, and carry digests of their own blocks; the metadata record also holds the
source's headers and digest, the id of the conversion, the title and the outgoing links. Ids are UUIDs made
from a digest of what the record is, so reruns agree. Everything is a projection: no shuffle, no Python.
"""

from __future__ import annotations

import functools
import gzip
from html.entities import name2codepoint

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.common import table

CRLF = "\r\n"
#: Elements that end a line of text, and elements whose content is not text.
LINES = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
HIDDEN = ("head", "script", "style", "noscript", "template")
_HIDDEN = "<(?:" + "|".join(rf"{name}(?:\s[^>]*)?>.*?</{name}" for name in HIDDEN) + r")\s*>"
#: Named character references of HTML 4, with the apostrophe that came later; a no-break space is a blank.
NAMED = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'", "nbsp": " "}
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_LINK = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
_REPLACEMENT = "\ufffd"


def _character(code: Column) -> Column:
    """The character of a code point; those that are none are replaced."""
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(bad, _REPLACEMENT).when(code == 160, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 32).otherwise(code)), 8, "0")), "UTF-32"))


def _entities(text: Column) -> Column:
    """Character references by name, decimal or hexadecimal number, in one pass; unknown ones stay as they are.

    The text is bound by a lambda: what computes it would run again for each mention of it otherwise.
    """
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(x: Column, i: Column) -> Column:
        part, ref = x["part"], x["ref"]
        code = F.when(ref.rlike("^#[xX]"), F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2)))
        char = F.when(ref.startswith("#"), _character(code.cast("long"))).otherwise(F.try_element_at(names, ref))
        return F.when(i == 0, part).otherwise(F.coalesce(F.when(ref != "", F.concat(char, F.substr(part, F.length(ref) + 2))), F.concat(F.lit("&"), part)))

    def whole(bound: Column) -> Column:
        parts = F.transform(F.split(bound, "&"), lambda p: F.struct(p.alias("part"), F.regexp_extract(p, _REFERENCE, 1).alias("ref")))
        return F.when(F.contains(bound, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(bound)

    return F.transform(F.array(text), whole)[0]


def plain_text(html: Column) -> Column:
    """Visible text: comments, hidden elements and tags gone, block elements on lines of their own, white space narrowed."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?is){_HIDDEN}", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[\r\n\t ]+", " "), rf"(?i)</?({LINES})(\s[^>]*)?/?>", "\n")
    text = _entities(F.regexp_replace(text, r"</?[a-zA-Z!][^>]*>", ""))
    text = F.regexp_replace(text, r" *\n[\n ]*", "\n")
    return F.trim(text, F.lit("\n "))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def _record_id(kind: str, *what: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(kind), *what).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html) as response rows: page_id, response_id, target_uri, warc_date, http_headers, payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), _record_id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.sha2(html.cast("binary"), 256)).alias("response_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), html.alias("payload"))


def derive(source: DataFrame) -> DataFrame:
    """Responses -> two rows each: page_id, record_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest, source_digest, block.

    Null or empty payloads give an empty conversion and a metadata record without title or links; null
    targets are written as empty. Repeated rows give repeated records with equal ids. Rows without page_id
    are derived like others. An empty table gives an empty result; other columns are not read.
    """
    conversion = _record_id("conversion", F.col("response_id"))
    title = F.trim(_entities(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title>", 1), r"[\r\n\t ]+", " ")))
    bare = lambda u: F.regexp_replace(u, r"^[\"']|[\"']$|[\r\n\t]", "")
    links = F.transform(F.regexp_extract_all("payload", F.lit(_LINK), 1), bare)
    with_parts = source.select("*", plain_text(F.col("payload")).alias("text"), _digest(F.col("payload")).alias("source_digest"), title.alias("title"), links.alias("links"), conversion.alias("conversion_id"))
    fields = F.concat(
        F.lit("refers-to: "), F.col("response_id"), F.lit(f"{CRLF}conversion: "), F.col("conversion_id"), F.lit(f"{CRLF}source-digest: "), F.col("source_digest"), F.lit(CRLF),
        F.when(F.col("title") != "", F.concat(F.lit("title: "), F.col("title"), F.lit(CRLF))).otherwise(F.lit("")),
        F.array_join(F.transform(F.split(F.regexp_replace("http_headers", "\r\n$", ""), CRLF), lambda h: F.concat(F.lit("source-header: "), h, F.lit(CRLF))), ""),
        F.array_join(F.transform("links", lambda u: F.concat(F.lit("outlink: "), _entities(u), F.lit(CRLF))), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), _record_id("metadata", F.col("response_id")).alias("record_id"), F.lit("application/warc-fields").alias("content_type"), F.col("fields").alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    each = with_parts.withColumn("fields", fields).select("page_id", F.col("response_id").alias("refers_to"), "target_uri", "warc_date", "source_digest", F.explode(kinds).alias("r"))
    block = F.col("r.block")
    return each.select("page_id", "r.record_type", "r.record_id", "refers_to", "target_uri", "warc_date", "r.content_type", F.octet_length(block).cast("long").alias("content_length"), _digest(block).alias("block_digest"), "source_digest", block.alias("block"))


def serialise(records: DataFrame) -> Column:
    """One WARC/1.1 record, header and block, without the two line ends that follow it. Null fields are left out."""
    named = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    head = [F.coalesce(F.concat(F.lit(f"{name}: "), records[col].cast("string"), F.lit(CRLF)), F.lit("")) for name, col in named]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *head, F.lit(CRLF), F.coalesce(records["block"], F.lit("")))


def _members(batches, root: str):
    """Records to a file of one gzip member each, under a name of this attempt; gives the name and number of records."""
    from pyarrow.fs import FileSystem

    target, path = FileSystem.from_uri(root)
    name, n, out = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.warc.gz", 0, None
    for batch in batches:
        for record in batch.column(0).to_pylist():
            out = out or target.open_output_stream(f"{path}/{name}", compression=None)
            out.write(gzip.compress(record.encode("utf-8", "surrogatepass") + b"\r\n\r\n"))
            n += 1
    if out:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])


def write_warc(records: DataFrame, path: str, members: bool = False) -> list[str]:
    """Records as files of WARC/1.1, one a partition; an existing folder is an error, an empty table writes no records.

    Without ``members`` Spark's text sink writes each file as one gzip stream, to any store that Spark reaches. With
    it every record is a member of its own, as readers that seek want; tasks then write by pyarrow's file systems
    (``path`` is a URI), and the names given back are those of attempts that counted: others may be deleted.
    """
    lines = records.select(serialise(records).alias("value"))
    if not members:
        lines.write.mode("errorifexists").option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
        return []
    from pyarrow.fs import FileSystem, FileType

    target, folder = FileSystem.from_uri(path)
    if target.get_file_info(folder).type != FileType.NotFound:
        raise ValueError(f"{path} is there already")
    target.create_dir(folder)
    return sorted(r["file"] for r in lines.mapInArrow(functools.partial(_members, root=path), "file string, records long").collect())


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC/1.1 files: record_type, record_id, target_uri, warc_date, block, intact, by Spark's text source.

    ``intact`` tells whether the block has its declared length in bytes; one that is no UTF-8, or that holds a
    record's first line itself, has not. Field names are read in any case; missing fields are null. Files may be
    plain or gzip, with one member or many.
    """
    raw = spark.read.option("lineSep", f"WARC/1.1{CRLF}").text(path).where("value <> ''")
    at = F.instr("value", CRLF * 2)
    head, rest = F.substr("value", F.lit(1), at + 1), F.substr("value", at + 4)
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    length = field("Content-Length").cast("long")
    block = F.when(rest.endswith(CRLF * 2), F.substr(rest, F.lit(1), F.length(rest) - 4)).otherwise(rest)
    parts = raw.select(field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("warc_date"), block.alias("block"), length.alias("length"))
    return parts.select("record_type", "record_id", "target_uri", "warc_date", "block", F.coalesce(F.octet_length("block") == F.col("length"), F.lit(False)).alias("intact"))


def responses_of(records: DataFrame) -> DataFrame:
    """Response records -> rows for ``derive``: page_id (null), response_id, target_uri, warc_date, http_headers, payload.

    Their own ids, dates and HTTP headers are kept; a block without an empty line is all headers. Records of other
    types and those that are not intact are left out: count them before.
    """
    at = F.instr("block", CRLF * 2)
    headers = F.when(at > 0, F.substr("block", F.lit(1), at + 1)).otherwise(F.col("block"))
    payload = F.when(at > 0, F.substr("block", at + 4)).otherwise("")
    some = records.where((F.col("record_type") == "response") & F.col("intact"))
    return some.select(F.lit(None).cast("long").alias("page_id"), F.col("record_id").alias("response_id"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), "warc_date", headers.alias("http_headers"), payload.alias("payload"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of every page, taken as a response; as ``derive``."""
    return derive(responses(table(spark, sf_dir, "pages")))


def _sql() -> str:
    def uuid(kind: str, what: str) -> str:
        h = f"sha256('{kind}|' || {what})"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    names = ", ".join(f"'{name}': chr({ord(char)})" for name, char in NAMED.items())

    def entities(x: str) -> str:
        ref = f"regexp_extract(k, '{_REFERENCE}', 1)"
        code = f"CASE WHEN {ref}[2] IN ('x', 'X') THEN CAST('0x' || {ref}[3:] AS BIGINT) ELSE CAST({ref}[2:] AS BIGINT) END"
        char = f"CASE WHEN {ref}[1] = '#' THEN CASE WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN chr(65533) WHEN {code} = 160 THEN ' ' ELSE chr(CAST({code} AS INTEGER)) END ELSE names[{ref}] END"
        each = f"lambda k, i: CASE WHEN i = 1 THEN k WHEN {char} IS NULL THEN '&' || k ELSE {char} || k[length({ref}) + 2:] END"
        return f"array_to_string(list_transform(string_split({x}, '&'), {each}), '')"

    text = "regexp_replace(payload, '<!--.*?-->', '', 'gs')"
    text = f"regexp_replace({text}, '{_HIDDEN}', ' ', 'gis')"
    text = rf"regexp_replace(regexp_replace({text}, '[\r\n\t ]+', ' ', 'g'), '</?({LINES})(\s[^>]*)?/?>', chr(10), 'gi')"
    text = entities(f"regexp_replace({text}, '</?[a-zA-Z!][^>]*>', '', 'g')")
    text = rf"regexp_replace(regexp_replace({text}, ' *\n[\n ]*', chr(10), 'g'), '^[\n ]+|[\n ]+$', '', 'g')"
    return rf"""
WITH named AS (SELECT MAP {{{names}}} AS names),
r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
         {uuid("response", "coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || sha256(coalesce(html, ''))")} AS response_id FROM pages),
p AS (
  SELECT *, {text} AS text, 'sha256:' || sha256(payload) AS source_digest, {uuid("conversion", "response_id")} AS conversion_id,
         trim({entities(r"regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title>', 1), '[\r\n\t ]+', ' ', 'g')")}) AS title,
         list_transform(regexp_extract_all(payload, '{_LINK.replace(chr(39), chr(39) * 2)}', 1), lambda u: regexp_replace(u, '^["'']|["'']$|[\r\n\t]', '', 'g')) AS links FROM r, named),
f AS (
  SELECT *, 'refers-to: ' || response_id || e || 'conversion: ' || conversion_id || e || 'source-digest: ' || source_digest || e
         || CASE WHEN title <> '' THEN 'title: ' || title || e ELSE '' END
         || 'source-header: HTTP/1.1 200 OK' || e || 'source-header: Content-Type: text/html; charset=utf-8' || e || 'source-header: Content-Length: ' || strlen(payload) || e
         || coalesce(array_to_string(list_transform(links, lambda u: 'outlink: ' || {entities("u")} || e), ''), '') AS fields
  FROM p, (SELECT chr(13) || chr(10) AS e)),
u AS (
  SELECT page_id, 'metadata' AS record_type, {uuid("metadata", "response_id")} AS record_id, response_id, target_uri, 'application/warc-fields' AS content_type, source_digest, fields AS block FROM f
  UNION ALL SELECT page_id, 'conversion', conversion_id, response_id, target_uri, 'text/plain; charset=utf-8', source_digest, text FROM f)
SELECT page_id, record_type, record_id, response_id AS refers_to, target_uri, '1970-01-01T00:00:00Z' AS warc_date, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, block FROM u
"""


OP8_SQL = _sql()
