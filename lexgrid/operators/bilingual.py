"""Pages in two languages side by side: where the gutter runs, and which words belong to which language.

All of it is Column expressions over one row per page, so pages are spread freely; only the gutter is a
property of a document, voted for by its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.operators.layout import SNAP
from lexgrid.operators.ordering import by_x, lines

#: Fixed values of bilingual pages: band of the gutter, least gap, pages that vote, share of words that may cross, words of a column and of half a line.
BAND, LEAST_GAP, VOTERS, CROSSING, COLUMN, HALF_LINE = (0.40, 0.65), 14.0, 40, 0.02, 20, 3
#: Fixed value: a number that hangs before a line, whose gap is no gutter.
HANGING = r"^\d{1,3}(?:\.\d+)?(?:\s?\(\d+\))?$"


def pages_of(words: DataFrame) -> DataFrame:
    """document, page, words (array of struct top, x0, x1, text, bold, bottom): one row for every page."""
    bottom = F.col("bottom").cast("double") if "bottom" in words.columns else F.lit(None).cast("double")
    word = F.struct(F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("bold"), F.lit(False)).alias("bold"), bottom.alias("bottom"))
    return words.groupBy("document", "page").agg(F.collect_list(word).alias("words"))


def _gaps(line: Column) -> Column:
    """Wide gaps between the words of a line: where they start and end, and the word before."""
    pairs = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda a, b: F.struct(a["x1"].alias("start"), b["x0"].alias("end"), a["text"].alias("before")))
    return F.filter(pairs, lambda g: g["end"] - g["start"] >= LEAST_GAP)


def gutters(pages: DataFrame, width: float) -> DataFrame:
    """document, gutter: the commonest end of a wide gap in the middle of evenly chosen pages, ties to the first seen; null without any."""
    low, high = BAND[0] * width, BAND[1] * width
    ends = F.flatten(F.transform(lines(F.col("words")), lambda line: F.transform(F.filter(_gaps(line), lambda g: g["end"].between(low, high)), lambda g: F.bround(g["end"]))))
    of = Window.partitionBy("document")
    voting = pages.select("document", "page", ends.alias("ends")).withColumns({"at": F.row_number().over(of.orderBy("page")) - 1, "pages": F.count("*").over(of)})
    voting = voting.where(F.col("at") % F.greatest(F.lit(1), F.floor(F.col("pages") / VOTERS)) == 0)
    votes = voting.select("document", "at", F.posexplode_outer("ends").alias("k", "end")).groupBy("document", "end").agg(F.count("end").alias("n"), F.min(F.struct("at", "k")).alias("first"))
    best = F.max_by("end", F.struct("n", -F.col("first.at"), -F.col("first.k")))
    return votes.groupBy("document").agg((best - SNAP).alias("gutter"))


def _is_prose(line: Column, gutter: Column) -> Column:
    """Two languages on one line: of its wide gaps one lies across the gutter and none beyond, with words enough on both sides."""
    gaps = F.filter(_gaps(line), lambda g: ~g["before"].rlike(HANGING))
    across = F.size(F.filter(gaps, lambda g: gutter.between(g["start"], g["end"])))
    sides = [F.size(F.filter(line, lambda w: w["x1"] <= gutter)), F.size(F.filter(line, lambda w: w["x0"] >= gutter))]
    return (across == 1) & F.forall(gaps, lambda g: g["start"] <= gutter) & (F.least(*sides) >= HALF_LINE)


def halves(words: DataFrame, width: float, languages: tuple[str, str]) -> DataFrame:
    """document, language, page, words, width, shared of every page and language; language is null for documents without a gutter.

    A page of two columns is cut at the gutter. On any other page the lines of prose are, and other lines go to
    both languages; a page without such lines is ``shared`` by both as it is.
    """
    pages = pages_of(words)
    placed = pages.join(gutters(pages, width), "document")
    g, all_words = F.col("gutter"), F.col("words")
    left, right = (lambda some: F.filter(some, lambda w: w["x1"] <= g)), (lambda some: F.filter(some, lambda w: w["x0"] >= g))
    crossing = F.size(F.filter(all_words, lambda w: (w["x0"] < g) & (w["x1"] > g)))
    columns = (F.size(all_words) >= 2 * COLUMN) & (crossing <= CROSSING * F.size(all_words)) & (F.least(F.size(left(all_words)), F.size(right(all_words))) >= COLUMN)
    found = placed.withColumn("columns", columns).withColumn("lines", F.when(~F.col("columns"), F.transform(lines(all_words), lambda line: F.struct(line.alias("words"), _is_prose(line, g).alias("prose")))))
    found = found.withColumn("shared", ~F.col("columns") & ~F.exists("lines", lambda x: x["prose"]))
    side = lambda cut: F.when(F.col("columns"), F.transform(cut(all_words), by_x)).otherwise(F.flatten(F.transform("lines", lambda x: F.when(x["prose"], cut(x["words"])).otherwise(x["words"]))))
    half = lambda name, cut, wide: F.struct(F.lit(name).alias("language"), side(cut).alias("words"), F.when(F.col("columns"), wide).otherwise(F.lit(width)).alias("width"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("language"), F.transform(all_words, by_x).alias("words"), F.lit(width).alias("width")))
    both = F.when(g.isNull(), whole).otherwise(F.array(half(languages[0], left, g), half(languages[1], right, width - g)))
    return found.select("document", "page", "shared", F.inline(both)).select("document", "language", "page", "words", "width", F.coalesce("shared", F.lit(False)).alias("shared"))
