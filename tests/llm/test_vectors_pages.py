"""Vector searches and WARC derivatives: brute force, SQL, round trips and edge cases."""

import gzip
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrid.llm.ann_int8 import nearest
from lexgrid.llm.common import table
from lexgrid.llm.exact_topk import highest, products
from lexgrid.llm.warc_derivatives import OP8_SQL, derive, op8_warc_derivatives, plain_text, read_warc, responses, responses_of, write_warc

SF = "/root/testdata/sf0.01"


def brute(rows, score, k):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            found = sorted((-score(v, w), c) for c, w in rows if c != q and len(w) == len(v))[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(found, 1)]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("scale", [1.0, 1e15])
def test_searches_against_brute_force(spark, scale):
    """Also with scores that floats cannot hold exactly, and with a third of all vectors equal."""
    rng = np.random.default_rng(1)
    rows = [(i, (scale * (np.ones(8) if i % 3 == 0 else rng.normal(size=8))).astype(np.float32).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    inner = lambda a, b: float(np.einsum("ij,ij->i", np.array([a]), np.array([b]))[0])
    assert result(nearest(df)) == brute(rows, inner, 20)
    whole = lambda a, b: max(-(1 << 63) + 1, min((1 << 63) - 1, sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))))
    assert result(highest(df)) == brute(rows, whole, 20)


def test_searches_on_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [math.nan, 1.0]), (None, [1.0, 1.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (5, [1.0, 2.0, 3.0]), (100, []), (120, [math.inf, 0.0]), (140, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("g", F.lit("x"))
    assert result(nearest(df)) == [(0, 1, 140, 5.0), (0, 2, 3, 4.0), (0, 3, 3, 4.0), (140, 1, 0, 5.0), (140, 2, 3, 4.0), (140, 3, 3, 4.0)]
    assert {r[0] for r in result(highest(df))} == {0, 20, 140}
    assert nearest(df.limit(0)).count() == 0 and highest(df.limit(0)).count() == 0


def test_every_row_of_a_query_id_is_answered(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (3, [2.0, 1.0]), (5, [1.0, 3.0]), (7, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = [(0, 1, 3, 2), (0, 1, 5, 3), (0, 1, 5, 3), (0, 2, 5, 1), (0, 2, 7, 3), (0, 2, 7, 3), (0, 3, 3, 1), (0, 3, 3, 1), (0, 3, 7, 1)]
    assert result(nearest(df)) == want
    assert result(highest(df)) == [(q, r, v, s * 64 * 64) for q, r, v, s in want]


def test_searches_of_huge_numbers(spark):
    """Norms and multiples that overflow exclude nobody."""
    rows = [(0, [1e200, 1.0]), (1, [1e100, 0.0]), (2, [2e100, 0.0]), (3, [-1e100, 5.0]), (20, [1e307, 1e307]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r[2] for r in result(nearest(df)) if r[0] == 0 and r[2] < 20] == [2, 1, 4, 3]
    assert len(result(highest(df))) == 10


def test_products_are_exact_at_every_size():
    rng = np.random.default_rng(3)
    for most in (60, 5_000, 1 << 24, 1 << 29):
        q, c = (np.floor(rng.uniform(-most, most, (4, 6))) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in c] for a in q]
        assert products(q, c).astype(np.int64).tolist() == want


def test_ann_on_the_table(spark):
    rows = [(r[0], r[1]) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    m = np.array([r[1] for r in rows], np.float64)
    ids = np.array([r[0] for r in rows])
    got = {(r[0], r[1]): r[2] for r in result(nearest(table(spark, SF, "embeddings")))}
    for q in np.nonzero(ids % 20 == 0)[0]:
        s = np.einsum("ij,ij->i", m, np.broadcast_to(m[q], m.shape))
        s[q] = -np.inf
        assert [got[int(ids[q]), n] for n in range(1, 21)] == ids[np.lexsort((ids, -s))[:20]].tolist()


def test_derivatives_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(OP8_SQL)
    got = op8_warc_derivatives(spark, SF)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_derivatives_on_odd_pages(spark):
    html = "<html><head><title>A &amp; B</title><script>x<y</script></head><body><!-- c --><p>Hi&nbsp;<b>you</b></p><a href='/x?a=1&amp;b=2'>go</a><br>end &lt;</body>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://c/", ""), (None, "http://d/", "plain"), (1, "http://a/", html)], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("block", F.lit("x"))
    got = derive(responses(pages)).collect()
    assert len(got) == 10
    text = next(r["block"] for r in got if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert text == "Hi you\ngo\nend <"
    meta = next(r["block"] for r in got if r["page_id"] == 1 and r["record_type"] == "metadata")
    assert "title: A & B\r\n" in meta and "outlink: /x?a=1&b=2\r\n" in meta and "source-header: HTTP/1.1 200 OK\r\n" in meta
    for r in got:
        assert r["refers_to"].startswith("<urn:uuid:") and r["content_length"] == len(r["block"].encode())
    assert derive(responses(pages.limit(0))).count() == 0


def test_character_references_and_links(spark):
    html = "<p>&#65;&#x42;&#X1F600;&#160;&eacute;&apos; &amp;lt; &nosuch; &#0; &#xD800; &#1114112; AT&T; &</p>" + "x" * 60_000
    text = spark.createDataFrame([(html,)], "h string").select(plain_text(F.col("h"))).first()[0]
    assert text.startswith("AB\U0001f600 é' &lt; &nosuch; \ufffd \ufffd \ufffd AT&T; &") and text.endswith("x" * 60_000)
    pages = spark.createDataFrame([(1, "u", "<a href=/bare>x</a><a class=b href = 'q?a=1&#38;b=2'>y</a><A HREF=\"one\ntwo\">z</A><a data-href='no'>n</a>")], "page_id long, url string, html string")
    meta = derive(responses(pages)).where("record_type = 'metadata'").first()["block"]
    assert [x for x in meta.split("\r\n") if x.startswith("outlink")] == ["outlink: /bare", "outlink: q?a=1&b=2", "outlink: onetwo"]


def test_text_is_computed_once_and_only_blanks_are_trimmed(spark, tmp_path):
    plan = spark.createDataFrame([], "h string").select(plain_text(F.col("h")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("<!--") == 1
    pages = spark.createDataFrame([(1, "u", " \n a&amp; \u0085"), (2, "u", "b \u2028"), (3, "u", "&nbsp; c &#32;\n")], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, op8_warc_derivatives(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(OP8_SQL).fetchall())


def as_responses(spark, path):
    """Two responses with headers of their own and a request, written by hand."""
    records = []
    for kind, uri, block in (("response", "http://a/é", "HTTP/1.1 404 Gone\r\nX-Own: 1\r\n\r\n<p>été</p>\r\n\r\nend"), ("request", "http://a/", "GET /"), ("response", "http://b/", "HTTP/1.1 204 None\r\n")):
        raw = block.encode()
        records.append(f"WARC/1.1\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2020-02-02T00:00:00Z\r\nContent-Length: {len(raw)}\r\n\r\n".encode() + raw + b"\r\n\r\n")
    path.mkdir()
    (path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    return str(path)


def test_derivatives_of_real_responses(spark, tmp_path):
    records = read_warc(spark, as_responses(spark, tmp_path / "in"))
    assert {(r["record_type"], r["intact"]) for r in records.collect()} == {("response", True), ("request", True)}
    got = {(r["refers_to"], r["record_type"]): r for r in derive(responses_of(records)).collect()}
    assert len(got) == 4
    meta, text = got["<urn:uuid:http://a/é>", "metadata"], got["<urn:uuid:http://a/é>", "conversion"]
    assert text["block"] == "été\nend" and text["target_uri"] == "http://a/é" and text["warc_date"] == "2020-02-02T00:00:00Z"
    assert "source-header: HTTP/1.1 404 Gone\r\nsource-header: X-Own: 1\r\n" in meta["block"] and text["record_id"] in meta["block"]
    assert got["<urn:uuid:http://b/>", "conversion"]["block"] == ""


@pytest.mark.parametrize("members", [False, True])
def test_warc_round_trip(spark, tmp_path, members):
    records = op8_warc_derivatives(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "warc")
    files = write_warc(records, path, members=members)
    read = read_warc(spark, path).collect()
    assert all(r["intact"] for r in read)
    want = {(r["record_type"], r["record_id"], r["block"]) for r in records.collect()}
    assert {(r["record_type"], r["record_id"], r["block"]) for r in read} == want and len(read) == len(want)
    if members:
        data = (tmp_path / "warc" / files[0]).read_bytes()
        one = zlib.decompressobj(31)
        assert one.decompress(data).endswith(b"\r\n\r\n") and one.unused_data.startswith(b"\x1f\x8b")
        with pytest.raises(ValueError, match="already"):
            write_warc(records, path, members=True)
