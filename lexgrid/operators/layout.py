"""Positioned words to lines, columns and matrices: what a page says, as a fold over its lines."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

#: Fixed values of the layout, in points.
LINE_TOLERANCE, GUTTER, BAND, SNAP, AGREE = 4.0, 30.0, (0.35, 0.70), 4.0, 2
MATRIX_REACH, MATRIX_COLUMNS = 14.0, 5
SUPERSCRIPT, RAISED_DIGITS = (0.8, 0.15), str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
SYMBOLS = {"P", "SD", "DA", "SP", "C", "X", "A", "-", "•"}
#: How an item of a list begins.
LIST_MARK = r"\((?:[a-z]{1,3}|[A-Z]{1,3}|\d{1,3})\)\s*\S"
_ZONE, _LIST = re.compile(r"-?[A-Z]{1,5}(?:-\d+)?"), re.compile(LIST_MARK)
AMENDMENT = r"[A-Z]{1,3}-\d+(?:\.\d+)+"
_AMENDMENT = re.compile(AMENDMENT)
_ROW = re.compile(r"\d+\.\d+(?:\([0-9a-zA-Z]+\))+")


@dataclass
class Scheme:
    """How a bylaw numbers clauses; ``titles``: headings carry their titles; ``named_rows``: so do rows of matrices."""

    clause: str
    parent: str
    titles: bool = True
    prefixed: bool = False
    named_rows: bool = False
    columns: int = MATRIX_COLUMNS
    zone: re.Pattern = _ZONE


#: Clause and parent headings by the name of the scheme.
SCHEMES = {
    "paren": Scheme(r"^(\d+\.\d+\(\d+[a-z]?\))\s*(.*)$", r"^(\d+\.\d+)\s+([A-Z][A-Z0-9 &/,'’()\-\.]{3,})$"),
    "dotted3": Scheme(r"^(\d+\.\d+\.\d+)\s+(.*)$", r"^(\d+\.\d+)\s+([A-Z][A-Za-z0-9 &/,'’()\-\.]{3,})$"),
    "dotted2": Scheme(r"^(\d+\.\d+)\s+(.*)$", r"^(\d+)\s+([A-Z][A-Z0-9 &/,'’()\-\.]{3,})$"),
    "moncton": Scheme(r"^(\d{1,3}(?:\s?\.\s?\d+)?(?:\s?\(\d+\))?)\.?\s+(.*)$", r"(?i)^(?:Division|Section)\s+(\d+\.\d+)\s+(.+)$", titles=False),
    "saintjohn": Scheme(r"^([1-9]\d?\.\d+(?:\(\d+[a-z]?\))?)\s+([A-Z\[].*)$", r"^([1-9]\d?)\s+([A-Z][A-Za-z].{3,})$"),
    "cbrm": Scheme(r"^(\d{1,2}\.\d{1,2})\.\s+(\S.*)$", r"^(\d{1,2})\.\d?\s+([A-Z][A-Z0-9 &/,'’()\-\.]{3,})$", named_rows=True, columns=3, zone=re.compile(r"-?[A-Z]{1,5}\d*(?:-\d+)?")),
    "stjohns": Scheme(r"^(?:SECTION\s+(\d{1,2})\s*[-–]\s*(\S.*)|(\d{1,2}(?:\.\d{1,2}){1,2}|\(\d{1,2}\))\s+(\S.*))$", r"^(?P<title>[A-Z][A-Z0-9 ,\-/&]*)\((?P<number>[A-Z0-9\-]{1,6})\)\s*ZONE$", prefixed=True),
    "summerside": Scheme(r"^(\d{1,2}\.\d{1,2}|\d{1,2}\.)\s+(\S.*)$", r"(?i)^(?P<title>.{3,60}?\((?P<number>[A-Za-z0-9]{1,5})\)\s*Zone)$", titles=False),
}


def cluster(words: list[dict], tolerance: float = LINE_TOLERANCE) -> list[list[dict]]:
    """Lines from top to bottom; a line's first word is the anchor that others must be near."""
    out: list[list[dict]] = []
    for w in sorted(words, key=lambda w: (w["top"], w["x0"])):
        if out and abs(w["top"] - out[-1][0]["top"]) <= tolerance:
            out[-1].append(w)
        else:
            out.append([w])
    return [sorted(line, key=lambda w: w["x0"]) for line in out]


def raised(word: dict, before: dict) -> bool:
    """A word is set as superscript of the one before: clearly smaller, on a clearly higher baseline."""
    size, other = (w["bottom"] - w["top"] if w.get("bottom") is not None else 0.0 for w in (word, before))
    return 0 < size < other * SUPERSCRIPT[0] and word["bottom"] < before["bottom"] - other * SUPERSCRIPT[1]


def text_of(line: list[dict]) -> str:
    """The words of a line, raised digits joined to what they belong to."""
    out = ""
    for before, w in zip([None, *line], line, strict=False):
        if before and w["text"].isdigit() and raised(w, before):
            out += w["text"].translate(RAISED_DIGITS)
        else:
            out += (" " if before else "") + w["text"]
    return out


def without_amendments(page: list[list[dict]]) -> tuple[list[list[dict]], list[str]]:
    """The lines without margin markers, and the markers, each once."""
    found = dict.fromkeys(w["text"] for line in page for w in line if _AMENDMENT.fullmatch(w["text"]))
    kept = [[w for w in line if not _AMENDMENT.fullmatch(w["text"])] for line in page]
    return [line for line in kept if line], list(found)


def _column_start(line: list[dict], width: float) -> float | None:
    """Where a line goes on after a gap as wide as a gutter, in the middle of the page."""
    for before, w in zip(line, line[1:], strict=False):
        if w["x0"] - before["x1"] >= GUTTER and BAND[0] * width <= w["x0"] <= BAND[1] * width:
            return w["x0"]
    return None


def _is_heading(line: list[dict], scheme: Scheme) -> bool:
    text = text_of(line).strip()
    return bool(line[0]["bold"]) and bool(re.match(scheme.clause, text) or re.match(scheme.parent, text))


def linearise(page: list[list[dict]], width: float, scheme: Scheme) -> list[list[dict]]:
    """Lines in reading order: the region of two columns left column first, all else as it stands.

    AGREE lines must agree on where the second column starts, to within SNAP. The region reaches from the first to
    the last line whose second part starts within GUTTER of that, and on over lines that keep to one side, up to a
    heading. Its edge lies left of the leftmost start, so that hanging markers stay with their column. Columns are
    taken apart only where AGREE right-hand parts begin with a list marker: values stay with their labels.
    """
    starts = {i: x for i, line in enumerate(page) if (x := _column_start(line, width)) is not None}
    votes = Counter(round(x / SNAP) * SNAP for x in starts.values())
    common = max(votes, key=votes.get, default=None)
    region = [i for i, x in starts.items() if abs(x - common) <= GUTTER]
    if common is None or votes[common] < AGREE or len(region) < AGREE:
        return page
    edge, top, end = min(starts[i] for i in region) - SNAP / 2, region[0], region[-1] + 1
    while end < len(page) and not _is_heading(page[end], scheme) and (all(w["x1"] <= edge for w in page[end]) or all(w["x0"] >= edge for w in page[end])):
        end += 1
    left, right = ([part for line in page[top:end] if (part := [w for w in line if (w["x0"] >= edge) == beyond])] for beyond in (False, True))
    listed = sum(bool(_LIST.match(text_of(part).strip())) for part in right)
    return page[:top] + left + right + page[end:] if listed >= AGREE else page


@dataclass
class Matrix:
    """Sentences of a matrix, its legend first, the labels of its rows, and the lines of the page that are no part of it."""

    sentences: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    rest: list[list[dict]] = field(default_factory=list)


def matrix(page: list[list[dict]], legend: dict[str, str], scheme: Scheme) -> Matrix:
    """A permission matrix: zones above, symbols in rows; cells go to the nearest heading within MATRIX_REACH, ties to the left.

    A row has a clause number for its label, with cells or without, or any label with cells where the
    scheme has named rows. Lines in capitals between rows name the rows below. Without rows there is no matrix.
    """
    centre = lambda w: (w["x0"] + w["x1"]) / 2
    heads: list[tuple[str, float]] = []
    category, out = "", Matrix()
    for line in page:
        if not heads:
            start = next((i for i in range(len(line), 0, -1) if not scheme.zone.fullmatch(line[i - 1]["text"])), 0)
            codes = line[start:]
            if len(codes) >= scheme.columns and not all(w["text"] in SYMBOLS for w in codes):
                heads = [(w["text"], centre(w)) for w in codes]
            else:
                out.rest.append(line)
            continue
        at = next((i for i in range(len(line), 0, -1) if line[i - 1]["text"] not in SYMBOLS), 0)
        label, cells = text_of(line[:at]), line[at:]
        if not (label and ((at == 1 and _ROW.fullmatch(label)) or (scheme.named_rows and cells))):
            if (whole := text_of(line)).isupper() and len(whole) > 2:
                category = whole
            else:
                out.rest.append(line)
            continue
        by: dict[str, list[str]] = {}
        for w in cells:
            name, x = min(heads, key=lambda h: abs(h[1] - centre(w)))
            if abs(x - centre(w)) <= MATRIX_REACH:
                by.setdefault(w["text"], []).append(name)
        said = "; ".join(f"{legend.get(c, c)}: {', '.join(z)}" for c, z in by.items()) or "no entry for any listed zone"
        out.labels.append(line[0]["text"])
        out.sentences.append(f"{category} {label}".strip() + f" - {said}.")
    if not out.sentences:
        return Matrix(rest=page)
    if legend:
        out.sentences.insert(0, "Legend: " + "; ".join(f"{symbol} = {meaning}" for symbol, meaning in legend.items()) + ".")
    return out
