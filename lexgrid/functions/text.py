"""Column functions over questions, clauses and chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of a section named in a question, the first that matches anywhere wins.
SECTION_PATTERNS = (r"\b(\d+\.\d+(?:\([0-9a-zA-Z]+\))+)", r"\b(\d+\.\d+\.\d+)\b", r"\b(\d+\.\d+)\b", r"(?i)\bsections?\s+(\d{1,2})\b", r"(?i)\barticles?\s+(\d{1,2})\b")
MAX_CHUNK, MIN_CHUNK = 2400, 120
BLANK = r"[\s\u0085  -     　]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def section_hint(question: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(question, p, 1), F.lit("")) for p in SECTION_PATTERNS])


def names_section(section: Column, hint: Column) -> Column:
    """The section begins with the hint, and no digit follows: 6.3 names 6.3(1) but not 6.30."""
    return section.startswith(hint) & ~F.substr(section, F.length(hint) + 1, F.lit(1)).rlike("[0-9]")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two spaces in front and one behind.

    Words stand three spaces apart, so one pattern reads every trigram and none that spans two words.
    """
    padded = F.concat(F.lit("  "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "   ")), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=(  [^ ]| [^ ].|[^ ]{2}.))"), 1))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two sets; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    return (F.floor(F.length(text) / F.lit(3.5)) + 1).cast("long")


def clean_text(text: Column) -> Column:
    """Runs of blanks narrowed, gaps before closing punctuation shut, at most one empty line in a row."""
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" +([.,;:)])", "$1")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def definition_term(body: Column) -> Column:
    """The term in quotes or guillemets at the head, else what stands before 'means', else six words."""
    quoted = F.regexp_extract(body, r"^[«\"“]\s*(.{1,80}?)\s*[»\"”]", 1)
    means = F.regexp_extract(body, r"^(.{1,80}?)\s+means\b", 1)
    return F.coalesce(F.nullif(F.trim(quoted), F.lit("")), F.nullif(F.trim(means), F.lit("")), F.array_join(F.slice(F.split(F.trim(body), r"\s+"), 1, 6), " "))


def _packed(parts: Column, limit: int, glue: str, least: int = 0) -> Column:
    """Parts joined greedily while they fit into ``limit`` characters; a single longer part stays whole, a last piece shorter than ``least`` joins the one before.

    The fold keeps where pieces start and how long the open one is; strings are joined once.
    """
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("now"), F.lit(0).alias("at"))

    def add(acc: Column, part: Column) -> Column:
        n, opens = F.length(part), (acc["at"] == 0) | (acc["now"] + len(glue) + F.length(part) > limit)
        return F.struct(F.when(opens, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]).alias("starts"), F.when(opens, n).otherwise(acc["now"] + len(glue) + n).alias("now"), (acc["at"] + 1).alias("at"))

    def joined(held: Column) -> Column:
        starts, all_parts = held["f"]["starts"], held["p"]
        stub = (F.size(starts) > 1) & (held["f"]["now"] < least)
        begins = F.array_append(F.when(stub, F.slice(starts, F.lit(1), F.size(starts) - 1)).otherwise(starts), F.size(all_parts))
        return F.zip_with(F.slice(begins, F.lit(1), F.size(begins) - 1), F.slice(begins, F.lit(2), F.size(begins) - 1), lambda a, b: F.array_join(F.slice(all_parts, a + 1, b - a), glue))

    folded = lambda p: F.struct(p.alias("p"), F.aggregate(p, start, add).alias("f"))
    return let(parts, lambda p: let(folded(p), joined))


def sub_clauses(text: Column) -> Column:
    """Blocks that each begin at a marker such as (a), (iv) or (12) at the start of a line."""
    blocks = F.split(text, r"\n(?=[^\S\n]*\((?:[a-z]{1,3}|[A-Z]{1,3}|\d{1,3})\)[^\S\n]+\S)")
    return F.filter(F.transform(blocks, strip), lambda b: b != "")


def clause_pieces(text: Column, limit: int = MAX_CHUNK, least: int = MIN_CHUNK) -> Column:
    """A clause in pieces of at most ``limit`` characters, cut at sub-clauses, then at sentence ends.

    An over-long sentence stays whole; a last piece shorter than ``least`` joins the one before. Null and
    blank texts have no pieces.
    """

    def block(b: Column) -> Column:
        return F.when(F.length(b) <= limit, F.array(b)).otherwise(_packed(F.split(b, r"(?<=[.;:])\s+(?=[A-Z(])"), limit, " "))

    def pieces(body: Column) -> Column:
        nothing = F.array().cast("array<string>")
        return F.when(F.coalesce(body, F.lit("")) == "", nothing).when(F.length(body) <= limit, F.array(body)).otherwise(_packed(F.flatten(F.transform(sub_clauses(body), block)), limit, "\n", least))

    return let(strip(text), pieces)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
