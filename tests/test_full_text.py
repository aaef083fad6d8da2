"""Stems, web queries and cover density against the plainest reading of their definitions."""

import random

import pytest

from lexgrid.functions.lexemes import BODY, TITLE, cover_rank, english_stem, french_stem, text_rank, vector, web_query
from lexgrid.operators.retrieval import keyword_search
from lexgrid.operators.store import indexed


@pytest.mark.parametrize("word, stem", [("consignment", "consign"), ("knightly", "knight"), ("happily", "happili"), ("generously", "generous"), ("national", "nation"), ("ponies", "poni"), ("ties", "tie"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("zoning", "zone"), ("skies", "sky"), ("by", "by"), ("communication", "communic"), ("fences", "fenc")])
def test_english_stems(word, stem):
    assert english_stem(word) == stem


@pytest.mark.parametrize("word, stem", [("continuait", "continu"), ("continuellement", "continuel"), ("majestueusement", "majestu"), ("maintenant", "mainten"), ("nationaux", "national"), ("majorité", "major"), ("malades", "malad"), ("chevaux", "cheval"), ("marcher", "march"), ("activité", "activ"), ("a", "a"), ("", "")])
def test_french_stems(word, stem):
    assert french_stem(word) == stem


def test_web_queries():
    assert [[(t.lexemes, t.negated) for t in b] for b in web_query('front yards or "the side yard" -fences')] == [[((("front", 0),), False), ((("yard", 0),), False)], [((("side", 0), ("yard", 1)), False), ((("fenc", 0),), True)]]
    assert web_query("the of and") == web_query("") == web_query(None) == ()
    assert vector("the yards", False) == ([("yard", 2)], 2)


def plain_rank(query, title, body):
    """All stretches of positions, kept if they satisfy the query and no shorter one inside does."""
    head, last = vector(title, False)
    tail, end = vector(body, False, last)
    at = dict((p, x) for x, p in head + tail)
    asked = {x for b in query for t in b for x, _ in t.lexemes}

    def holds(term, lo, hi):
        return any(all(p + g <= hi and at.get(p + g) == x for x, g in term.lexemes) for p in range(lo, hi + 1))

    def good(lo, hi):
        return any(all(holds(t, lo, hi) for t in b if not t.negated) and not any(holds(t, 1, end) for t in b if t.negated) for b in query)

    if not good(1, end):
        return None
    covers = [(lo, hi) for lo in range(1, end + 1) for hi in range(lo, end + 1) if good(lo, hi) and not good(lo + 1, hi) and not good(lo, hi - 1)]
    total = 0.0
    for lo, hi in covers:
        inside = [p for p in range(lo, hi + 1) if at.get(p) in asked]
        mean = len(inside) / sum(1 / (TITLE if p <= last else BODY) for p in inside)
        total += mean / (1 + (hi - lo + 1 - len(inside)))
    return total


@pytest.mark.parametrize("seed", range(60))
def test_cover_density_is_what_it_says(seed):
    r = random.Random(seed)
    query = web_query(r.choice(["red blue", "red or blue green", '"red blue"', '"red blue" green', "red -blue", 'red "green red" or blue', "red"]))
    title, body = (" ".join(r.choices(["red", "blue", "green", "the", "grey"], k=r.randint(0, n))) for n in (4, 22))
    got, want = cover_rank(query, title, body, False), plain_rank(query, title, body)
    assert got == want if want is None else got == pytest.approx(want)


def test_ranks_over_rows(spark):
    ddl = "id long, municipality_id string, language string, section_number string, section_title string, chunk_content string"
    rows = [(1, "a", "en", "1.1", "Fences", "About walls"), (2, "a", "en", "1.2", None, "A fence is low"), (3, "a", "en", "1.3", "", None), (4, "b", "en", "1.4", "Fences", "x"), (5, "a", "fr", "1.5", None, "fences")]
    chunks = spark.createDataFrame(rows, ddl)
    found = keyword_search(chunks, "fencing or fences", "a", "en", full_text=True).collect()
    assert [(r["id"], round(r["rank"], 6)) for r in found] == [(1, round(0.8 * 1.0 / 2.0, 6)), (2, round(0.8 * 0.4 / 1.4, 6))]
    assert keyword_search(chunks, "  ", "a", "en", full_text=True).count() == 0
    assert chunks.select(text_rank(chunks.section_title, chunks.chunk_content, "the")).distinct().collect()[0][0] is None


@pytest.mark.parametrize("question", ["fencing or fences", '"low fence" -walls', "about walls near fences", "-walls", "the", ""])
@pytest.mark.parametrize("language", ["en", "fr"])
def test_kept_lexemes_and_trigrams_give_the_same_hits(spark, question, language):
    ddl = "id long, municipality_id string, language string, section_number string, section_title string, chunk_content string"
    rows = [(1, "a", "en", "1.1", "Fences", "About walls"), (2, "a", "en", "1.2", None, "A low fence is low, a fence is"), (3, "a", "en", "1.3", "Fences", None), (4, "b", "en", "1.4", "Fences", "x"), (5, "a", "fr", "1.5", None, "about walls, fences"), (6, "a", "en", "1.6", "", "")]
    chunks = spark.createDataFrame(rows, ddl)
    kept = indexed(chunks)
    assert [r["id"] for r in kept.where("content_grams IS NULL").collect()] == [3]
    hits = lambda some: [(r["id"], round(r["rank"], 9)) for r in keyword_search(some, question, "a", language, full_text=True).collect()]
    assert hits(kept) == hits(chunks)
