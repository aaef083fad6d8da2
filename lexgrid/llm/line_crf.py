"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's potentials come from its own features and those of
the lines before and after it; neighbouring labels share a transition potential. Forward-backward gives
each line's chance of being good, and their mean, weighted by line length, is calibrated to the score.

Labels exist for documents only. Training starts from lines that carry their document's label; after each
round the lines of bad documents that look good are relabelled, as long as their document keeps a bad line.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.common import few, fold_of, labelled_sample, score_of, table
from lexgrid.llm.toxicity import fit_logistic

#: Bounds of the sample that the field is fitted on: rows, and characters of a text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 12_000
FOLDS, HELD_OUT, GOOD = 4, 2, 0.7
#: Lines of a training text are chained in stretches of at most this many.
STRETCH = 128
_RATIOS = (0.001, 0.03, 0.08, 0.15, 0.3, 0.6)
#: Upper ends of the bins of every feature.
BINS = (
    ("characters", (1, 20, 60, 120, 240, 480, 960)),
    ("upper", _RATIOS), ("digits", _RATIOS), ("signs", _RATIOS), ("stops", _RATIOS), ("bars", _RATIOS),
    ("repeats", _RATIOS), ("distinct", (0.05, 0.15, 0.3, 0.5, 0.7, 0.9)), ("word", (1.5, 3, 4, 5, 6, 8, 12)),
    ("marked", _RATIOS), ("again", (0.5,)), ("stopped", (0.5,)),
)
_OFFSETS = np.cumsum([0] + [len(b) + 1 for _, b in BINS])
WIDTH = int(_OFFSETS[-1])


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """0 letter in lower case or other, 1 upper case, 2 digit, 3 space, 4 sign, 5 stop or comma, 6 bar."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        out[i] = 3 if c.isspace() else 1 if c.isupper() else 2 if c.isdigit() else 6 if c == "|" else 5 if c in ".,;:!?'\"-" else 0 if c.isalpha() else 4
    return out


def line_features(lines: list[str]) -> np.ndarray:
    """One bin per feature and line, as places in a vector of WIDTH."""
    n = len(lines)
    x = _classes()[np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.fromiter(map(len, lines), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    count = lambda k: np.add.reduceat((x == k).astype(np.int32), starts)
    full = np.maximum(sizes, 1)
    words = [line.split() for line in lines]
    many = np.fromiter(map(len, words), np.int64, n)
    some = np.maximum(many, 1)
    repeats = np.fromiter((sum(map(operator.eq, w, w[1:])) for w in words), np.int64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, n)
    marked = np.fromiter((sum(not w[-1].isalnum() and w[-2:-1] == w[-1:] for w in ws) for ws in words), np.int64, n)
    seen: set[str] = set()
    again = np.zeros(n)
    stopped = np.zeros(n)
    for i, line in enumerate(lines):
        again[i] = line in seen
        seen.add(line)
        stopped[i] = line.rstrip()[-1:] in (".", "!", "?", "…")
    values = (sizes, count(1) / full, count(2) / full, count(4) / full, count(5) / full, count(6) / full, repeats / some, distinct / some, (full - count(3)) / some, marked / some, again, stopped)
    return np.column_stack([np.searchsorted(bins, v) + o for (_, bins), v, o in zip(BINS, values, _OFFSETS, strict=False)])


def potentials(features: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-odds of good against bad from a line and its two neighbours within its document; w: (3, WIDTH + 1)."""
    own = w[0][features].sum(axis=1) + w[0][-1]
    before, after = w[1][features].sum(axis=1), w[2][features].sum(axis=1)
    out = own.copy()
    out[1:] += before[:-1]
    out[:-1] += after[1:]
    out[starts] = own[starts] + w[1][-1]
    inner = ends - 1 > starts
    out[starts[inner]] += after[starts[inner] + 1]
    last = (ends - 1)[inner]
    out[last] = own[last] + before[last - 1]
    out[ends - 1] += w[2][-1]
    return out


def marginals(odds: np.ndarray, starts: np.ndarray, ends: np.ndarray, same: float) -> tuple[np.ndarray, np.ndarray]:
    """Chance of good per line, and that a line and the one before agree, by forward-backward in log space.

    All chains of a batch advance together; a batch takes as many steps as its longest chain has lines.
    """
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    step = lambda v: np.logaddexp(v + same, 0) - np.logaddexp(v, same)  # noqa: E731  log-odds carried over one transition
    forward, backward = np.empty_like(odds), np.zeros_like(odds)
    if longest:
        forward[starts] = odds[starts]
    for t in range(1, longest):
        at = starts[: active[t]] + t
        forward[at] = odds[at] + step(forward[at - 1])
    for t in range(longest - 1, 0, -1):
        at = starts[: active[t]] + t
        backward[at - 1] = step(odds[at] + backward[at])
    good = 1 / (1 + np.exp(-np.clip(forward + backward, -40, 40)))
    agree = np.ones_like(odds)
    inner = np.ones(len(odds), bool)
    inner[starts] = False
    at = np.nonzero(inner)[0]
    a, b = forward[at - 1], odds[at] + backward[at]
    both, neither = same + np.logaddexp(a + b, 0), np.logaddexp(a, b)
    agree[at] = np.exp(both - np.logaddexp(both, neither))
    return good, agree


def _bounds(sizes: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    if most:
        sizes = np.concatenate([[most] * (s // most) + [s % most] * (s % most > 0) for s in sizes.tolist()]).astype(np.int64)
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def _train(features, starts, ends, y, weight, steps, ridge=2e-4):
    """Maximum likelihood by Adam; y: 1 for good lines. The gradient is observed less expected feature counts."""
    w, same = np.zeros((3, WIDTH + 1)), 0.0
    m, v = np.zeros((3 * (WIDTH + 1) + 1,)), np.zeros((3 * (WIDTH + 1) + 1,))
    first = np.zeros(len(y), bool)
    first[starts] = True
    last = np.zeros(len(y), bool)
    last[ends - 1] = True
    agreed = np.r_[False, y[1:] == y[:-1]] & ~first
    for step in range(1, steps + 1):
        good, agree = marginals(potentials(features, starts, ends, w), starts, ends, same)
        d = (y - good) * weight
        g = np.zeros((3, WIDTH + 1))
        spread = lambda r: np.bincount(features.ravel(), weights=np.repeat(r, features.shape[1]), minlength=WIDTH)
        g[0, :-1], g[0, -1] = spread(d), d.sum()
        g[1, :-1], g[1, -1] = spread(np.where(last, 0, np.r_[d[1:], 0])), d[first].sum()
        g[2, :-1], g[2, -1] = spread(np.where(first, 0, np.r_[0, d[:-1]])), d[last].sum()
        grad = np.r_[g.ravel() / len(y) - ridge * w.ravel(), ((agreed - np.where(first, 0, agree)) * weight).sum() / len(y) - ridge * same]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        w += move[:-1].reshape(w.shape)
        same = min(6.0, same + move[-1])
    return w, same


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def document_quality(good: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' chances, as log-odds; empty lines weigh as one character."""
    weight = np.maximum(lengths, 1).astype(float)
    q = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def fit(sample: Iterable[tuple[str, int]], rounds: int = 2, steps: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, transition and calibration; texts are kept as features only. One class only gives a constant score."""
    labels, sizes, features, lengths = [], [], [np.zeros((0, len(BINS)), np.int16)], []
    for text, y in sample:
        lines = split_lines(text)
        labels.append(y)
        sizes.append(len(lines))
        features.append(line_features(lines).astype(np.int16))
        lengths.extend(map(len, lines))
    labels, sizes, features, lengths = np.array(labels, float), np.array(sizes), np.concatenate(features), np.array(lengths)
    if not len(labels) or labels.min() == labels.max():
        return np.zeros((3, WIDTH + 1)), 0.0, fit_logistic(np.zeros((len(labels), 1)), labels)
    of = np.repeat(np.arange(len(sizes)), sizes)
    starts, ends = _bounds(sizes, STRETCH)
    whole = _bounds(sizes)
    share = labels.mean()
    weight = np.where(labels[of] == 1, 0.5 / share, 0.5 / (1 - share))
    y = labels[of].copy()
    for _ in range(rounds):
        w, same = _train(features, starts, ends, y, weight, steps)
        good, _ = marginals(potentials(features, *whole, w), *whole, same)
        worst = np.minimum.reduceat(good, whole[0])
        y = np.where((labels[of] == 0) & (good > 0.5) & (worst[of] < 0.5), 1.0, labels[of])
    w, same = _train(features, starts, ends, y, weight, steps)
    good, _ = marginals(potentials(features, *whole, w), *whole, same)
    return w, same, fit_logistic(document_quality(good, lengths, whole[0])[:, None], labels, ridge=1e-3)


def score_texts(texts: list[str | None], w: np.ndarray, same: float, calibration: np.ndarray) -> np.ndarray:
    split = [split_lines(t) for t in texts]
    features = np.concatenate([line_features(t) for t in split])
    starts, ends = _bounds(np.array([len(t) for t in split]))
    good, _ = marginals(potentials(features, starts, ends, w), starts, ends, same)
    q = document_quality(good, np.array([len(line) for t in split for line in t]), starts)
    return 1 / (1 + np.exp(-np.clip(q * calibration[0] + calibration[1], -30, 30)))


def _scorer(w, same, calibration):
    def score(texts: list[str | None]) -> np.ndarray:
        return np.concatenate([score_texts(texts[at : at + 512], w, same, calibration) for at in range(0, len(texts), 512)])

    return score


def _fitted(labelled: DataFrame, labels: DataFrame):
    sample = labelled_sample(labelled, labels, "quality", FOLDS, HELD_OUT, SAMPLE_ROWS, SAMPLE_CHARS).select("text", "label")
    return functools.partial(_scorer, *fit(sample.toLocalIterator()))


def quality(documents: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, held_out, score, predicted; one row per document.

    Fitted on at most SAMPLE_ROWS rows of ``labelled`` that ``labels`` (doc_id, quality) marks outside the
    held-out fold; labels other than 0 and 1 are ignored. Null texts score like empty ones, which are one
    empty line. Rows without doc_id are scored and belong to no fold (held_out false); repeated rows repeat
    their score. Without labels of both classes every score is the same. An empty table gives an empty
    result. Columns other than doc_id and text are not read.
    """
    out = documents.select(F.col("doc_id").cast("long"), score_of(F.col("text"), _fitted(labelled, labels)).alias("score"))
    return out.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def without_bad(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns as they are, whose score reaches GOOD; fitted on labelled ones among them."""
    return documents.where(score_of(F.col("text"), _fitted(documents, labels)) >= GOOD)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score; as ``quality``, in few files."""
    documents = table(spark, sf_dir, "documents")
    return few(quality(documents, documents, table(spark, sf_dir, "labels")))
