"""Operators on small fixtures: sections, fusion, chunks, store, layout, frames."""

import pytest
from pyspark.sql import functions as F

from lexgrid.functions.answer import client_key, context, disclaimer, frames, has_disclaimer, logged
from lexgrid.functions.text import clause_pieces, clean_text, definition_term, names_section, section_hint, similarity, token_estimate, trigrams
from lexgrid.operators.checks import cascade, violations
from lexgrid.operators.assembly import NO_GUTTER, Page, assemble, bilingual_clauses, kind, page_facts, read_page
from lexgrid.operators.bilingual import gutters, halves, pages_of
from lexgrid.operators.layout import SCHEMES, cluster, linearise, matrix, text_of, without_amendments
from lexgrid.operators.ordering import lines
from lexgrid.operators.retrieval import fuse
from lexgrid.operators.store import decision, insert_missing, orphans, pending, repeated_keys, replace_table, upsert
from lexgrid.streaming.streams import cut_frames


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("question, hint", [("tell me about 6.3(1)(a)", "6.3(1)(a)"), ("rule 6.3.2 please", "6.3.2"), ("what is 8.14", "8.14"), ("Section 7 on fences", "7"), ("article 12", "12"), ("must be 3 metres from the lot line", None), ("", None)])
def test_section_hint(spark, question, hint):
    assert one(spark, section_hint(F.lit(question))) == hint


def test_prefix_needs_a_boundary(spark):
    for section, yes in {"6.3": True, "6.3(1)(a)": True, "6.30": False, "16.3": False}.items():
        assert one(spark, names_section(F.lit(section), F.lit("6.3"))) is yes


def test_trigrams(spark):
    assert set(one(spark, trigrams(F.lit("Cat")))) == {"  c", " ca", "cat", "at "}
    assert one(spark, similarity(trigrams(F.lit("word")), trigrams(F.lit("two words")))) == pytest.approx(4 / 11)
    assert one(spark, similarity(trigrams(F.lit("")), trigrams(F.lit("")))) == 0


def test_texts(spark):
    assert one(spark, clean_text(F.lit("  a \t b .\n\n\n\nc "))) == "a b.\n\nc"
    assert one(spark, definition_term(F.lit("« abri d'auto » Garage privé"))) == "abri d'auto"
    assert one(spark, definition_term(F.lit("Convenience Store means a use"))) == "Convenience Store"
    assert one(spark, definition_term(F.lit("a b c d e f g"))) == "a b c d e f"
    assert one(spark, token_estimate(F.lit(""))) == 1


def fold(text, limit, least):
    """The same packing, one block after another."""
    import re

    text = text.strip()
    if len(text) <= limit:
        return [text] if text else []
    blocks = [b.strip() for b in re.split(r"\n(?=[^\S\n]*\((?:[a-z]{1,3}|[A-Z]{1,3}|\d{1,3})\)[^\S\n]+\S)", text) if b.strip()]
    parts = []
    for b in blocks:
        found, glue = [b], " "
        if len(b) > limit:
            found = []
            for s in re.split(r"(?<=[.;:])\s+(?=[A-Z(])", b):
                if found and len(found[-1]) + 1 + len(s) <= limit:
                    found[-1] += glue + s
                else:
                    found.append(s)
        parts += found
    out = []
    for p in parts:
        if out and len(out[-1]) + 1 + len(p) <= limit:
            out[-1] += "\n" + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least:
        out[-2:] = ["\n".join(out[-2:])]
    return out


@pytest.mark.parametrize("limit", [40, 90, 300])
def test_clause_pieces_lose_nothing(spark, limit):
    text = "Opening line of the clause\n" + "\n".join(f"({c}) item {c} says this. And more; Then it ends" for c in "abcdefg") + "\n(a)\nbare marker stays.\n(iv) last"
    got = one(spark, clause_pieces(F.lit(text), limit, 20))
    assert got == fold(text, limit, 20)
    assert "".join("".join(got).split()) == "".join(text.split())
    assert one(spark, clause_pieces(F.lit("   "))) == [] and one(spark, clause_pieces(F.lit(None).cast("string"))) == []


def test_fusion_rules(spark):
    rows = [(0, 1, "a", 0.66, None), (0, 2, "b", 0.5, None), (1, 1, "c", None, 1.0), (1, 2, "b", None, 0.9), (1, 3, "a", None, 0.1)]
    lists = spark.createDataFrame(rows, "list int, position int, id string, similarity double, rank double")
    got = {r["id"]: r for r in fuse(lists).collect()}
    assert [got[i]["fused_rank"] for i in "abc"] == [1, 2, 3]
    assert got["a"]["score"] == pytest.approx(1 / 61 + 1 / 63) and got["b"]["score"] == pytest.approx(2 / 62)
    assert (got["b"]["similarity"], got["b"]["rank"]) == (0.5, 0.9)
    assert (got["a"]["similarity"], got["a"]["rank"]) == (0.66, None)
    only = fuse(lists.where("list = 0 AND position = 1")).first()
    assert only["score"] == pytest.approx(1 / 61)
    assert {r["id"]: r["fused_rank"] for r in fuse(lists, {0: 1.0, 1: 10.0}).collect()}["c"] == 3


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, h string, made int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 99)], "id int, h string, made int")
    rows = lambda df: sorted(map(tuple, df.select("id", "h", "made").collect()))
    assert rows(upsert(old, new, ["id"], keep=("made",))) == [(1, "a", 10), (2, "B", 20), (3, "c", 99)]
    assert rows(insert_missing(old, new, ["id"])) == [(1, "a", 10), (2, "b", 20), (3, "c", 99)]
    assert rows(orphans(old, new, ["id"])) == [(1, "a", 10)]
    assert rows(pending(new, old.withColumn("h", F.lit("B")), ["id"], "h")) == [(3, "c", 99)]
    assert repeated_keys(old.unionByName(old), ["id"]).count() == 2
    path = replace_table(spark, old, str(tmp_path), ["id"])
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        replace_table(spark, old.unionByName(old), str(tmp_path), ["id"])
    for previous, force, want in ((None, False, "new"), ("x", False, "content_changed"), ("y", False, "unchanged"), ("y", True, "forced")):
        assert one(spark, decision(F.lit(previous).cast("string"), F.lit("y"), F.lit(force))) == want


def test_checks(spark):
    t = spark.createDataFrame([(1, "en"), (2, "de")], "id int, lang string")
    assert [tuple(r) for r in violations(t, "id", {"language": ~F.col("lang").isin("en", "fr")}).collect()] == [(2, "language")]
    child = spark.createDataFrame([(10, 1), (11, 2)], "cid int, parent int")
    kept = cascade(t, F.col("id") == 1, [(child, "parent", "id")])
    assert kept[1].select("cid").collect() == [(11,)]


def test_answers(spark):
    note = one(spark, disclaimer(F.lit("fr"), F.to_date(F.lit("2024-05-01"))))
    assert "2024-05-01" in note and one(spark, has_disclaimer(F.lit(note)))
    assert "NOT yet been verified" in one(spark, disclaimer(F.lit("en"), F.lit(None).cast("date")))
    assert one(spark, logged(F.lit("x" * 20_001))).endswith("x... [truncated]")
    assert one(spark, client_key(F.lit("1.2.3.4"), F.lit("  "))) == "1.2.3.4" and one(spark, client_key(F.lit("1.2.3.4"), F.lit("s" * 70))) == "1.2.3.4:" + "s" * 64
    passage = lambda n, title: F.struct(F.lit(n).alias("position"), F.lit("[A - B, Section 1]").alias("citation"), F.lit(title).cast("string").alias("title"), F.lit(4).alias("page"), F.lit("text").alias("content"))
    assert one(spark, context(F.array(passage(2, None), passage(1, "T")))) == "[Passage 1] CITE AS: [A - B, Section 1]\nSection title: T\nPage: 4\ntext\n\n---\n\n[Passage 2] CITE AS: [A - B, Section 1]\nPage: 4\ntext"


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_frames_survive_any_cut(spark, eol):
    body = "".join(f'event: token{eol}data: {{"n": {i}}}{eol}{eol}' for i in range(5)) + f"data: nonsense{eol}{eol}"
    want = [("token", f'{{"n": {i}}}') for i in range(5)]
    assert [tuple(e) for e in one(spark, frames(F.lit(body)))] == want
    for step in (1, 7, 40):
        rest, got = "", []
        for i in range(0, len(body), step):
            found, rest = cut_frames(rest + body[i : i + step])
            got += found
        assert got == want


# --- layout ----------------------------------------------------------------------------------------


def word(text, x0, top, bold=False):
    return {"text": text, "x0": float(x0), "x1": float(x0 + 6 * len(text)), "top": float(top), "bottom": top + 11.0, "bold": bold}


def test_lines_have_anchors(spark):
    words = [word("c", 100, 95), word("a", 60, 92), word("b", 80, 93), word("d", 60, 97)]
    assert [[w["text"] for w in line] for line in cluster(words)] == [["a", "b", "c"], ["d"]]
    rows = spark.createDataFrame([(w["top"], w["x0"], w["x1"], w["text"], w["bold"], w["bottom"]) for w in words], "top double, x0 double, x1 double, text string, bold boolean, bottom double")
    got = rows.agg(lines(F.collect_list(F.struct("top", "x0", "x1", "text", "bold", "bottom"))).alias("x")).first()[0]
    assert [[w["text"] for w in line] for line in got] == [["a", "b", "c"], ["d"]]


def line_of(text, x0, top, bold=False):
    """Words of six points a character, a blank apart."""
    out = []
    for t in text.split():
        out.append(word(t, x0, top, bold))
        x0 += 6 * (len(t) + 1)
    return out


def read(words):
    return [text_of(line) for line in linearise(cluster(words), 612, SCHEMES["paren"])]


def use_list():
    rows = [("(a) Permitted Uses", 143, 308), ("(b) Conditional Uses", 358, 308), ("(1) Day Care", 143, 326), ("(1) Kennel", 372, 326), ("(2) Home Work", 143, 343), ("(2) Studio", 372, 343), ("(3) House", 143, 361), ("(4) Hens", 143, 380)]
    return [w for r in rows for w in line_of(*r)]


def test_columns_are_taken_apart_for_lists():
    """The left list runs on below the right one, and a marker that hangs left stays with its column."""
    assert read(use_list()) == ["(a) Permitted Uses", "(1) Day Care", "(2) Home Work", "(3) House", "(4) Hens", "(b) Conditional Uses", "(1) Kennel", "(2) Studio"]
    ended = use_list() + line_of("8.14(3) Standards", 143, 400, bold=True) + line_of("(z) last", 143, 420)
    assert read(ended)[-4:] == ["(1) Kennel", "(2) Studio", "8.14(3) Standards", "(z) last"]
    capital = [w for k, t in enumerate((100, 120)) for w in line_of(f"({'AB'[k]}) left", 143, t) + line_of(f"({'CD'[k]}) right", 358, t)]
    assert read(capital) == ["(A) left", "(B) left", "(C) right", "(D) right"]


def test_values_stay_with_their_labels():
    rows = [("(a) Lot Area", 117, 473, True), ("(i) Interior Lot:", 144, 501), ("345 m", 388, 501), ("(ii) Corner Lot", 144, 521), ("480 m", 388, 521), ("(i) Interior", 144, 577), ("11.5 metres", 388, 577), ("(ii) Corner", 144, 590), ("14.0 metres", 388, 590), ("Yard", 144, 604), ("- none", 388, 604)]
    assert read([w for r in rows for w in line_of(*r)]) == ["(a) Lot Area", "(i) Interior Lot: 345 m", "(ii) Corner Lot 480 m", "(i) Interior 11.5 metres", "(ii) Corner 14.0 metres", "Yard - none"]


def test_prose_and_single_columns_stay():
    prose = line_of("All uses shall comply with the rules that apply to all uses", 72, 432) + line_of("and to houses (Section 7).", 72, 446)
    assert read(prose) == ["All uses shall comply with the rules that apply to all uses", "and to houses (Section 7)."]
    assert read(line_of("(a) left", 143, 100) + line_of("(1) right", 358, 100)) == ["(a) left (1) right"]
    assert read([]) == []


def test_amendments_leave_the_text():
    page, marks = without_amendments([[word("Z-5.197", 20, 100), word("text", 60, 100)], [word("Z-5.197", 20, 120)]])
    assert marks == ["Z-5.197"] and [[w["text"] for w in line] for line in page] == [["text"]]


def test_matrix_cells_go_to_the_nearest_column():
    zones = ["LC", "NC", "DC", "RC", "OC", "RLF"]
    head = [word(z, 190 + 24 * i, 100) for i, z in enumerate(zones)]
    row = [word("6.4(2)(a)", 60, 120)] + [word("P", 192 + 24 * i, 120) for i in range(4)] + [word("SD", 190 + 24 * 5, 120)]
    assert matrix([head, [word("SIGNS", 60, 110)], row, [word("6.4(2)(b)", 60, 140)]], {"P": "Permitted"}, SCHEMES["paren"]).sentences == ["Legend: P = Permitted.", "SIGNS 6.4(2)(a) - Permitted: LC, NC, DC, RC; SD: RLF.", "SIGNS 6.4(2)(b) - no entry for any listed zone."]


def test_clauses():
    pages = [Page(1, [("stray text", False), ("2.1 GENERAL RULES", True), ("2.1(1) Fences", True), ("A fence is low.", False), ("“ berm ” means a bank", False)]), Page(2, [("of earth.", False), ("2.1(2) Walls", True), ("2.1(3) not bold, so text", False)])]
    got = assemble(pages, SCHEMES["paren"])
    assert [(c["section_number"], c["section_title"], c["text"], c["page_number"], c["parent"]) for c in got] == [
        ("2.1(1)", "Fences", "A fence is low.", 1, "2.1 GENERAL RULES"),
        ("2.1(1)", "berm", "“ berm ” means a bank\nof earth.", 1, None),
        ("2.1(2)", "Walls", "2.1(3) not bold, so text", 2, "2.1 GENERAL RULES"),
    ]
    untitled = assemble([Page(1, [("Height of walls", True), ("82. 1 (1) No wall is high.", False)])], SCHEMES["moncton"])
    assert [(c["section_number"], c["section_title"], c["text"]) for c in untitled] == [("82.1(1)", "Height of walls", "No wall is high.")]


def test_numbers_of_section_chapters():
    found = assemble([Page(1, [("SECTION 2 - Uses", True), ("Text.", False), ("MINI HOME PARK (MHP) ZONE", True), ("(1) PERMITTED USES", True), ("Homes.", False)])], SCHEMES["stjohns"])
    assert [(c["section_number"], c["section_title"], c["parent"]) for c in found] == [("2", "Uses", None), ("MHP(1)", "PERMITTED USES", "MHP MINI HOME PARK")]


def test_definitions_and_tables():
    pages = [
        Page(1, [("(7) Utility means a pipe", False), ("or wire.", False)], part="2", part_title="Définitions"),
        Page(2, [("2.1(1) Scope", True), ("Everything.", False), ("Berm means a bank", True), ("a wall means nothing", False), ("« allée", False), ("privée » Voie étroite", False)]),
        Page(3, [("cell 1", False), ("TABLE 12.1 - Yards", False)], label="2-3", standalone=True),
        Page(4, [], table=["6.4(1) - P: LC."], table_number="6.4", table_title="ZONES"),
        Page(5, [("tail", False)]),
    ]
    got = [(c["section_number"], c["section_title"], c["text"]) for c in assemble(pages, SCHEMES["paren"])]
    assert got == [
        ("2(7)", "Utility", "Utility means a pipe\nor wire."),
        ("2.1(1)", "Scope", "Everything."),
        ("2.1(1)", "Berm", "Berm means a bank\na wall means nothing"),
        ("2.1(1)", "allée privée", "« allée privée » Voie étroite"),
        ("Table 12.1", "Yards", "cell 1\nTABLE 12.1 - Yards"),
        ("6.4", "ZONES", "6.4(1) - P: LC."),
    ]


def test_superscripts():
    small = {"text": "2", "x0": 90.0, "x1": 93.0, "top": 99.0, "bottom": 104.0, "bold": False}
    assert text_of([word("345", 60, 100), word("m", 84, 100), small]) == "345 m²"
    assert text_of([word("case", 60, 100), word("2", 90, 100)]) == "case 2"


def test_pages_have_headers_labels_and_kinds():
    page = read_page([word("Section", 60, 20), word("8", 110, 20), word("Zones", 130, 20), word("Text", 60, 60), word("8-37", 300, 700)], 5, SCHEMES["paren"], 612)
    assert (page.part, page.part_title, page.label, page.lines) == ("8", "Zones", "8-37", [("Text", False)])
    lines = lambda *texts: Page(1, [(t, False) for t in texts])
    assert kind(lines(*[f"Heading 2-{i}" for i in range(4)])) == "toc"
    assert kind(lines(*[f"{i} Short heading" for i in range(12)])) == "contents"
    assert kind(lines(*["word – mot"] * 12)) == "term_index"
    assert kind(lines(*["General Rules 4"] * 8)) == "divider"
    assert kind(lines("Amendment", "Published Date")) == "register"
    assert kind(lines()) == kind(lines("A plain line of text.")) == "body"


def bilingual_page(top=0.0):
    out = []
    for i in range(10):
        for k in range(4):
            out += [word(f"l{i}", 40 + 44 * k, top + 20 * i), word(f"r{i}", 330 + 44 * k, top + 20 * i)]
    return out


def test_legends_lose_banners_beside_them():
    zones = ["LC", "NC", "DC", "RC", "OC"]
    top = [word(t, 60 + 70 * i, 80) for i, t in enumerate(["P", "=", "Permitted", "LIMITED", "ZONES"])]
    page = read_page([*top, *(word(z, 190 + 24 * i, 100) for i, z in enumerate(zones)), word("6.4(1)", 60, 120), word("P", 192, 120)], 1, SCHEMES["paren"], 612)
    assert page.table == ["Legend: P = Permitted.", "6.4(1) - Permitted: LC."] and page.table_number == "6.4"
    assert matrix(cluster([*(word(z, 190 + 24 * i, 100) for i, z in enumerate(zones)), word("6.4(1)", 60, 120)]), {}, SCHEMES["paren"]).sentences == ["6.4(1) - no entry for any listed zone."]


WORDS = "document long, page int, text string, x0 double, x1 double, top double, bottom double, bold boolean"


def placed(spark, *pages):
    """(document, page, words) as a table of words."""
    return spark.createDataFrame([(d, p, w["text"], w["x0"], w["x1"], w["top"], w["bottom"], w["bold"]) for d, p, some in pages for w in some], WORDS)


def test_gutters(spark):
    two = bilingual_page() + [word("far", 380, 400)] + [word("x", 40, 420), word("y", 280, 420)]
    got = {r["document"]: r["gutter"] for r in gutters(pages_of(placed(spark, (1, 1, two), (1, 2, bilingual_page()), (2, 1, [word("alone", 60, 10)]), (3, 1, [word("a", 40, 10), word("b", 300, 10)]), (3, 2, [word("a", 40, 10), word("b", 350, 10)]))), 612).collect()}
    assert got == {1: 326, 2: None, 3: 296}


def test_halves_of_pages(spark):
    """Columns, lines of prose among others, and pages that both languages share."""
    table = [word(f"c{k}", 40 + 60 * k, 10) for k in range(9)]
    mixed = line_of("l0 l1 l2 l3", 40, 30) + line_of("r0 r1 r2 r3", 330, 30) + [word("wide", 40, 50), word("row", 250, 50), word("of", 340, 50), word("cells", 440, 50)]
    hanging = [word("12", 10, 30), *mixed[:8]]
    got = {(r["page"], r["language"]): r for r in halves(placed(spark, (1, 1, bilingual_page()), (1, 2, table), (1, 3, mixed), (1, 4, hanging)), 612, ("en", "fr")).collect()}
    texts = lambda page, language: [w["text"] for w in got[page, language]["words"]]
    assert set(texts(1, "en")) == {f"l{i}" for i in range(10)} and set(texts(1, "fr")) == {f"r{i}" for i in range(10)}
    assert (got[1, "en"]["width"], got[1, "fr"]["width"], got[3, "en"]["width"]) == (326, 286, 612)
    assert got[2, "en"]["shared"] and texts(2, "en") == texts(2, "fr") == [f"c{k}" for k in range(9)] and not got[3, "fr"]["shared"]
    assert texts(3, "en") == ["l0", "l1", "l2", "l3", "wide", "row", "of", "cells"] and texts(3, "fr") == ["r0", "r1", "r2", "r3", "wide", "row", "of", "cells"]
    assert texts(4, "en") == ["12", "l0", "l1", "l2", "l3"] and texts(4, "fr") == ["r0", "r1", "r2", "r3"]


def test_bilingual_clauses(spark):
    both = []
    for i in range(12):
        head = i % 4 == 0
        both += line_of(f"10{i}.1 The left" if head else "left says more", 40, 20 * i, head) + line_of(f"10{i}.1 La droite" if head else "droite dit plus", 330, 20 * i, head)
    rows = bilingual_clauses(placed(spark, (1, 1, both), (2, 1, [word("alone", 60, 10)]))).collect()
    got = {(r["document"], r["language"], r["seq"]): (r["section_number"], r["text"], r["error"]) for r in rows}
    assert got[1, "en", 0] == ("100.1", "The left\nleft says more\nleft says more\nleft says more", None) and got[1, "fr", 2][1].startswith("La droite\ndroite")
    assert got[2, None, 0] == (None, None, NO_GUTTER) and len(got) == 7


def test_words_without_text_or_place_are_left_out(spark):
    ddl = "document long, page int, text string, x0 double, x1 double, top double, bold boolean, extra string"
    rows = [(1, 1, None, 1.0, 2.0, 3.0, True, "x"), (1, 1, "a", None, 2.0, 3.0, True, "x"), (2, 1, "b", 1.0, 2.0, 3.0, None, "x")]
    assert [r["document"] for r in page_facts(spark.createDataFrame(rows, ddl)).collect()] == [2]
    assert page_facts(spark.createDataFrame([], ddl)).count() == bilingual_clauses(spark.createDataFrame([], ddl)).count() == 0
    assert [(r["document"], r["error"]) for r in bilingual_clauses(spark.createDataFrame(rows, ddl)).collect()] == [(2, NO_GUTTER)]
