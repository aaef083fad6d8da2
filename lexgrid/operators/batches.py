"""Many pages at once: the words of a batch of pages as arrays, their lines, and what two languages side by side share out.

Everything that a word takes part in is an array operation over all pages of a batch; only lines and pages are looked at
one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexgrid.operators.bilingual import BAND, COLUMN, CROSSING, HALF_LINE, HANGING, LEAST_GAP, VOTERS
from lexgrid.operators.layout import LINE_TOLERANCE, SNAP


@dataclass
class Words:
    """Words by the row of their page, in order of rows; ``bottom`` is nan where there is none."""

    page: np.ndarray
    top: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    bold: np.ndarray
    bottom: np.ndarray
    text: pa.Array

    def take(self, at: np.ndarray) -> Words:
        return Words(self.page[at], self.top[at], self.x0[at], self.x1[at], self.bold[at], self.bottom[at], self.text.take(pa.array(at)))

    def matches(self, pattern: str) -> np.ndarray:
        """Words that a pattern of Python's fits whole."""
        whole = pattern.replace(r"\d", r"\p{Nd}")
        return pc.match_substring_regex(self.text, rf"\A(?:{whole})\z").to_numpy(zero_copy_only=False)


def words_of(pages: pa.Array) -> Words:
    """A column of arrays of words."""
    flat = pages.flatten()
    kind = flat.type
    at = np.repeat(np.arange(len(pages)), pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False))
    some = lambda name: pc.struct_field(flat, name)
    number = lambda name: some(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
    bottom = number("bottom").astype(np.float64) if kind.get_field_index("bottom") >= 0 else np.full(len(flat), np.nan)
    return Words(at, number("top"), number("x0"), number("x1"), pc.fill_null(some("bold"), False).to_numpy(zero_copy_only=False), bottom, some("text"))


@dataclass
class Lines:
    """Places of words from line to line and left to right; where lines start among them, with the end; pages of lines."""

    order: np.ndarray
    starts: np.ndarray
    page: np.ndarray

    def of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.page)), np.diff(self.starts))


def lines_of(w: Words, tolerance: float = LINE_TOLERANCE) -> Lines:
    """As layout.cluster for every page: only heights, not words, are looked at one by one."""
    order = np.lexsort((w.x0, w.top, w.page))
    page, top = w.page[order], w.top[order]
    heights = np.flatnonzero(np.r_[True, (page[1:] != page[:-1]) | (top[1:] != top[:-1])]) if len(order) else np.empty(0, np.int64)
    starts, on, anchor = [], -1, 0.0
    for i, p, t in zip(heights.tolist(), page[heights].tolist(), top[heights].tolist(), strict=True):
        if p != on or abs(t - anchor) > tolerance:
            starts.append(i)
            on, anchor = p, t
    bounds = np.array([*starts, len(order)], np.int64)
    line = np.repeat(np.arange(len(starts)), np.diff(bounds))
    return Lines(order[np.lexsort((w.x0[order], line))], bounds, page[bounds[:-1]])


def texts_of(w: Words, found: Lines) -> list[str]:
    """Lines as text, without regard to raised digits."""
    words = pa.ListArray.from_arrays(pa.array(found.starts, pa.int32()), w.text.take(pa.array(found.order)).cast(pa.string()))
    return pc.binary_join(words, " ").to_pylist()


def dicts_of(w: Words, found: Lines, lines: range) -> list[list[dict]]:
    """Lines as words with all they have."""
    out = []
    for k in lines:
        at = found.order[found.starts[k] : found.starts[k + 1]]
        columns = (w.text.take(pa.array(at)).to_pylist(), *(c[at].tolist() for c in (w.x0, w.x1, w.top, w.bold, w.bottom)))
        out.append([{"text": t, "x0": a, "x1": b, "top": y, "bold": bool(z), "bottom": None if c != c else c} for t, a, b, y, z, c in zip(*columns, strict=True)])
    return out


def sides(w: Words, document: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """As bilingual.gutters and halves for whole documents, whose pages stand in order; ``document``: numbers of the pages' documents, from 0.

    Gives the gutters of documents (nan without one), which pages both languages share, and for each language the places of its words and the widths of its pages.
    """
    n, found = len(document), lines_of(w)
    order, line = found.order, found.of_words()
    page, x0, x1 = w.page[order], w.x0[order], w.x1[order]
    gap = np.flatnonzero((line[1:] == line[:-1]) & (x0[1:] - x1[:-1] >= LEAST_GAP))
    start, end = x1[gap], x0[gap + 1]
    first = np.searchsorted(document, document)
    pages = np.bincount(document)[document]
    votes = (((np.arange(n) - first) % np.maximum(1, pages // VOTERS)) == 0)[page[gap]] & (end >= BAND[0] * width) & (end <= BAND[1] * width)
    ballots, seen, count = np.unique(np.c_[document[page[gap]][votes], np.rint(end[votes])], axis=0, return_index=True, return_counts=True)
    gutter = np.full(document[-1] + 1 if n else 0, np.nan)
    best = np.lexsort((seen, -count, ballots[:, 0]))[::-1]
    gutter[ballots[best, 0].astype(np.int64)] = ballots[best, 1] - SNAP  # the last one written is the best
    of_page = gutter[document]
    g = of_page[page]
    left, right, crossing = x1 <= g, x0 >= g, (x0 < g) & (x1 > g)
    per_page = lambda some: np.bincount(page[some], minlength=n)
    size = np.bincount(page, minlength=n)
    columns = (size >= 2 * COLUMN) & (per_page(crossing) <= CROSSING * size) & (np.minimum(per_page(left), per_page(right)) >= COLUMN)
    hangs = pc.match_substring_regex(w.text.take(pa.array(order[gap])), HANGING).to_numpy(zero_copy_only=False)
    at = g[gap]
    per_line = lambda some: np.bincount(some, minlength=len(found.page))
    across, beyond = per_line(line[gap][~hangs & (start <= at) & (at <= end)]), per_line(line[gap][~hangs & (start > at)])
    prose = (across == 1) & (beyond == 0) & (np.minimum(per_line(line[left]), per_line(line[right])) >= HALF_LINE)
    shared = ~columns & (np.bincount(found.page[prose], minlength=n) == 0) & ~np.isnan(of_page)
    cut = columns[page] | prose[line]
    whole = np.full(n, width)
    return gutter, shared, [order[~cut | left], order[~cut | right]], [np.where(columns, of_page, whole), np.where(columns, width - of_page, whole)]
