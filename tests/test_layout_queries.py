"""Layout queries on texts that look like something else, against their SQL."""

import duckdb
import pytest

from lexgrid.plans import catalogue

#: A page of text in an odd document with two right-hand parts that begin like markers of a list, and a last line that looks like a label.
TEXTS = {
    1: "one two three four (735) 555-5082 seven eight\nleft only\na b c d e f g h\n1 2 3 4 (414) 555-4653\n555-1170",
    2: "one two three four (735) 555-5082 seven eight\na b c d (b) f\nw\n12 - 7",
    3: "\n".join(["a b c d e f g h"] * 29 + ["555-8630", "x y"]),
    4: "\n".join(["a  b", "", "a b c d (e) f g h i j k l (m) n"] * 50 + ["555-1170"]),
    5: "", 6: None, 7: "  ",
}


@pytest.mark.parametrize("name", ["q48_near_column_linearise", "q50_clause_assembly", "q56_page_facts", "q57_bilingual_clauses"])
def test_texts_that_look_like_marks(spark, tmp_path, name):
    rows = [(k, t, "en", "src1", len(t or "")) for k, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    want = con.sql(catalogue.oracle_sql()[name]).select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_pages_are_read_where_they_are_laid_out(spark, sf):
    """Words of a document are moved once, for its gutter; else only what was read is."""
    exchanges = lambda name: catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert [exchanges(q) for q in ("q56_page_facts", "q48_near_column_linearise", "q57_bilingual_clauses", "q50_clause_assembly")] == [0, 0, 1, 1]
