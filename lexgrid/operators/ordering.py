"""Folds over ordered rows: line clustering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_TOLERANCE = 4.0
_WORD = "struct<top:double,x0:double,x1:double,text:string,bold:boolean,bottom:double>"


def lines(words: Column, tolerance: float = LINE_TOLERANCE) -> Column:
    """Words (array of struct top, x0, x1, text, bold, bottom) as lines, each an array of words from left to right.

    Words are taken from top to bottom; one opens a new line when it lies more than ``tolerance`` away from the
    first word of the line, which is why neighbours' distances would not do. The fold keeps the place at which
    each line begins; words are sliced once.
    """
    ordered = F.array_sort(words.cast(f"array<{_WORD}>"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def add(done: Column, w: Column) -> Column:
        opens = done["anchor"].isNull() | (F.abs(w["top"] - done["anchor"]) > tolerance)
        grown = F.when(opens, F.array_append(done["starts"], done["at"])).otherwise(done["starts"])
        return F.struct(F.when(opens, w["top"]).otherwise(done["anchor"]).alias("anchor"), (done["at"] + 1).alias("at"), grown.alias("starts"))

    def cut(held: Column) -> Column:
        some = held["words"]
        begins = F.array_append(F.aggregate(some, start, add)["starts"], F.size(some))
        spans = F.zip_with(F.slice(begins, F.lit(1), F.size(begins) - 1), F.slice(begins, F.lit(2), F.size(begins) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(spans, lambda s: F.array_sort(F.transform(F.slice(some, s["a"] + 1, s["b"] - s["a"]), by_x)))

    return F.element_at(F.transform(F.array(F.struct(ordered.alias("words"))), cut), 1)


def by_x(w: Column) -> Column:
    return F.struct(*[w[c].alias(c) for c in ("x0", "top", "x1", "text", "bold", "bottom")])
