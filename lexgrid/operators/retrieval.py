"""Vector, keyword and hybrid retrieval over chunk rows; every search names its tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.functions.lexemes import squashed, stored_rank, text_rank
from lexgrid.functions.text import names_section, similarity, trigrams
from lexgrid.functions.vector import cosine

THRESHOLD, COUNT, RRF_K, TRIGRAM_FLOOR = 0.3, 5, 60, 0.3


def scoped(chunks: DataFrame, tenant: str, language: str | None = None) -> DataFrame:
    """The chunks of a tenant and, if given, of a language; both filters reach the scan."""
    out = chunks.where(F.col("municipality_id") == tenant)
    return out if language is None else out.where(F.col("language") == language)


def match(chunks: DataFrame, vector: list[float], tenant: str, language: str | None = None, threshold: float = THRESHOLD, count: int = COUNT) -> DataFrame:
    """The nearest chunks above a similarity threshold, ties to smaller ids."""
    q = F.lit([float(x) for x in vector])
    hits = scoped(chunks, tenant, language).where(F.col("embedding").isNotNull()).withColumn("similarity", cosine(F.col("embedding"), q))
    return hits.where(F.col("similarity") > threshold).orderBy(F.col("similarity").desc(), "id").limit(count)


def grams_of(chunks: DataFrame) -> Column:
    """The trigrams of chunks, as they are kept or else as their texts have them."""
    return F.col("content_grams") if "content_grams" in chunks.columns else trigrams(F.col("chunk_content"))


def tier_scores(grams: Column, section: Column, question: str, hint: str | None, more: Column | None = None) -> Column:
    """Best of the tiers exact section (1.00), section prefix (0.90), ``more`` below 0.80 and trigram similarity, in one pass over the row.

    Null without a match. Texts are looked at only where the section doesn't decide.
    """
    sim = similarity(grams, trigrams(F.lit(question)))
    by_text = F.greatest(*([more] if more is not None else []), F.when(sim >= TRIGRAM_FLOOR, sim * 0.5), F.lit(None).cast("double"))
    if not hint:
        return by_text
    return F.when(section == hint, F.lit(1.0)).when(names_section(section, F.lit(hint)), F.lit(0.9)).otherwise(by_text)


def keyword_search(chunks: DataFrame, question: str, tenant: str, language: str | None = None, hint: str | None = None, count: int = COUNT, full_text: bool = False) -> DataFrame:
    """The best chunks by their best tier; ``full_text`` adds the tier of cover density, squashed below 0.80.

    The language decides the stemmer of that tier, French or else English; a column section_title counts
    above the body. Blank questions leave the tiers of the hint. Columns that ``store.indexed`` keeps are read
    in place of the texts.
    """
    hits = scoped(chunks, tenant, language)
    more = None
    if full_text:
        title = F.col("section_title") if "section_title" in chunks.columns else F.lit(None).cast("string")
        french = language == "fr"
        more = squashed(stored_rank(F.col("content_tsv"), question, french) if "content_tsv" in chunks.columns else text_rank(title, F.col("chunk_content"), question, french))
    hits = hits.withColumn("rank", tier_scores(grams_of(chunks), F.col("section_number"), question, hint, more))
    return hits.where(F.col("rank").isNotNull()).orderBy(F.col("rank").desc(), "section_number", "id").limit(count)


def fuse(lists: DataFrame, weights: dict[int, float] | None = None, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (by.., list, position, id, similarity, rank).

    Scores add up weight / (k + position) over all places. The row kept for an id is the first seen, unless
    a later one has a strictly stronger signal; then a missing or zero signal is filled from the row it
    replaces. Order: score, strongest signal, first seen; both to 12 places. A list without a weight among ``weights`` is an error.
    """
    weight = F.lit(1.0)
    if weights is not None:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weight = F.coalesce(F.try_element_at(given, F.col("list")), F.raise_error(F.concat(F.lit("no weight for list "), F.col("list").cast("string"))).cast("double"))
    raw = F.round(F.greatest(F.coalesce("similarity", F.lit(0.0)), F.coalesce("rank", F.lit(0.0))), 12)
    seen = F.sort_array(F.collect_list(F.struct("list", "position", raw.alias("raw"), "similarity", "rank")))
    or_ = lambda a, b: F.coalesce(F.nullif(a, F.lit(0.0)), b)
    best = F.aggregate(F.slice("seen", 2, F.size("seen")), F.element_at("seen", 1), lambda kept, new: F.when(new["raw"] > kept["raw"], F.struct(kept["list"].alias("list"), kept["position"].alias("position"), F.greatest(new["raw"], kept["raw"]).alias("raw"), or_(new["similarity"], kept["similarity"]).alias("similarity"), or_(new["rank"], kept["rank"]).alias("rank"))).otherwise(kept))
    grouped = lists.groupBy(*by, "id").agg(F.sum(weight / (k + F.col("position"))).alias("score"), seen.alias("seen")).withColumn("best", best)
    order = [F.round("score", 12).desc(), F.col("best.raw").desc(), F.col("best.list"), F.col("best.position"), F.col("id")]
    ranked = grouped.withColumn("fused_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.select(*by, "id", "fused_rank", "score", F.col("best.similarity").alias("similarity"), F.col("best.rank").alias("rank"))


def ranked(hits: DataFrame, number: int, order: list[Column], by: tuple[str, ...] = (), limit: int = COUNT) -> DataFrame:
    """Hits as a ranked list for fusion: list, position, id, similarity, rank."""
    out = hits.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= limit)
    for c in ("similarity", "rank"):
        out = out if c in out.columns else out.withColumn(c, F.lit(None).cast("double"))
    return out.select(*by, F.lit(number).alias("list"), "position", "id", "similarity", "rank")
