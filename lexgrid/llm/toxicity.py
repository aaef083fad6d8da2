"""Toxicity through a noisy channel: obfuscated words are restored before they are scored.

The channel writes letters as look-alikes, parts them by white space or signs, and repeats them. A word in
such dress becomes a lattice of readings, and Viterbi search under a character trigram model picks the
likeliest. White space within a stretch of fragments is an edge like the others: it ends a word or was put
into one. The model is counted over all documents; its size is fixed by the alphabet.

Scores come from restored words: a word's evidence is the lower confidence bound of the share of toxic
texts among the labelled ones that hold the word or its beginning. A logistic regression over the strongest
evidence, the number of toxic words and the length gives the score.

Only what some reading could turn into evidence is decoded when scoring: a token, or fragments in a row, whose
letters with every run narrowed to one don't begin like a feature with evidence have no reading that does.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.common import fold_of, labelled_sample, mix, score_of, table

#: Bounds of the sample that the classifier is fitted on: rows, and characters of a text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 5000, 12_000
FOLDS, HELD_OUT, TOXIC = 5, 0, 0.5
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœšž"
CODES = {c: i + 1 for i, c in enumerate(_LETTERS)}
SYMBOLS = 64
#: Signs and the letters they stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "#": "h", "%": "x", "*": "aeiou"}
#: Costs in nats: reading a sign as a letter, passing over a sign, a letter that repeats, a double letter read as one.
READ, WILD, SKIP, REPEAT, DOUBLE = 1.0, 3.0, 8.0, 0.7, 9.0
#: The same for white space that was put into a word, between single characters and beside longer fragments, and for
#: white space between single characters that ends a word nevertheless.
LETTERS_APART, GROUPS_APART, END_APART = 0.3, 2.5, 1.5
#: Tokens of at most so many characters belong to a stretch of fragments.
FRAGMENT = 3
_PLAIN = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1")
_EDGES, _LEADS = ".,;:!?\"'()[]{}<>|*#$%&=~^_/\\-", ".,;:?\"'()[]{}<>|*#%&=~^_/\\-"
_LINKS = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}")
_NUMBER = re.compile(r"\d{4}")


# --- the character model ---------------------------------------------------------------------------


@functools.lru_cache(1)
def _codes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c, i in CODES.items():
        out[ord(c)] = i
    return out


def _count(batches):
    """(text) -> (gram, n): trigrams of codes, 0 for everything that is no letter; one row each and task."""
    total = np.zeros(SYMBOLS**3, np.int64)
    codes = _codes()
    for batch in batches:
        held, size = [], 0
        for t in [*batch.column(0).to_pylist(), None]:
            if t is not None:
                held.append(t)
                size += len(t)
            if held and (t is None or size > 1_000_000):
                x = codes[np.frombuffer(f"\n\n{'\n\n'.join(held)}\n".lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
                total += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS**3)
                held, size = [], 0
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])


def character_model(documents: DataFrame) -> np.ndarray:
    """-log p(c | a, b) over all documents as a table of 64 ** 3 floats, interpolated with lower orders."""
    counts = np.zeros(SYMBOLS**3)
    for gram, n in documents.select(F.col("text").cast("string")).mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3).astype(np.float32)


# --- the channel -----------------------------------------------------------------------------------


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of equal characters: (letters, cost), '' where it is passed over, as no digit of a long number is.

    White space, single blanks here, is the end of a word (' ') or passed over.
    """
    out, number = [], _NUMBER.search(stretch)
    for m in re.finditer(r"(.)\1*", stretch, re.S):
        c, n = m[1], len(m[0])
        if c == " ":
            apart = not stretch[max(0, m.start() - 2) : m.start() - 1].strip() and not stretch[m.end() + 1 : m.end() + 2].strip()
            out.append([(" ", END_APART), ("", LETTERS_APART)] if apart else [(" ", 0.0), ("", GROUPS_APART)])
        elif c in CODES or c.isalpha():
            out.append([(c * k, (DOUBLE if n == 2 else REPEAT) * (n != k)) for k in dict.fromkeys((1, 2, n)) if k <= n])
        elif c in LEET:
            cost = WILD if len(LEET[c]) > 2 else READ
            once = DOUBLE if n == 2 and c.isdigit() else REPEAT
            out.append([(x * k, cost + once * (n != k)) for x in LEET[c] for k in dict.fromkeys((1, min(n, 2)))] + ([] if number and c.isdigit() else [("", SKIP)]))
        else:
            out.append([("", 0.0)])
    return out


def _search(stretch: str, model: np.ndarray) -> tuple[float, str]:
    """Cost and letters of the likeliest reading. A step holds a state for two letters of context, however long the stretch."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in lattice(stretch):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for letters, price in readings:
                x, y, total = a, b, cost + price
                for c in letters:
                    z = CODES.get(c, 0)
                    total += float(model[x, y, z])
                    x, y = (0, 0) if c == " " else (y, z)
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = total, (path, letters) if letters else path
        states = after
    cost, path = min(((cost + float(model[a, b, 0]), path) for (a, b), (cost, path) in states.items()), key=lambda found: found[0])
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return cost, "".join(reversed(out))


def decode(stretch: str, model: np.ndarray) -> str:
    """The likeliest letters and word ends behind a stretch, by Viterbi search over its lattice with two letters of context."""
    return _search(stretch, model)[1]


def _as_it_stands(token: str, model: np.ndarray) -> float:
    """Cost of a token whose digits are digits, any of ten, and whose signs are signs."""
    x = y = 0
    total = 0.0
    for c in token:
        z = CODES.get(c, 0)
        total += float(model[x, y, z]) + math.log(10) * c.isdigit()
        x, y = y, z
    return total + float(model[x, y, 0])


def core(token: str) -> str:
    """A token in lower case without the signs at its ends; one that may stand for a letter stays in front."""
    return token.lower().rstrip(_EDGES).lstrip(_LEADS)


def restore(token: str, model: np.ndarray) -> str:
    """A token as it was meant: plain words in lower case without the signs at their ends, others decoded.

    Links, e-mail addresses and tokens without letters stay as they are. So do those with four digits in a
    row where the model finds the number likelier than any word behind it.
    """
    low = core(token)
    if not low or (low.isalpha() and not _RUN.search(low)):
        return low
    if not re.search(r"[^\W\d_]|[@$]", low) or _LINKS.fullmatch(low):
        return low
    cost, word = _search(low, model)
    return low if _NUMBER.search(low) and _as_it_stands(low, model) <= cost else word


def part(tokens: list[str], i: int) -> str:
    """A token as a fragment: a sign between single characters may stand for a letter."""
    t = tokens[i]
    return core(t) or (t if t in LEET and 0 < i < len(tokens) - 1 and len(tokens[i - 1]) == len(tokens[i + 1]) == 1 else "")


def restore_stretch(fragments: list[str], model: np.ndarray) -> list[str]:
    """The words behind fragments in a row: the decoder chooses which of them belong together."""
    return decode(" ".join(filter(None, (part(fragments, i) for i in range(len(fragments))))), model).split()


def spelled(tokens: list[str]) -> list[list[str]]:
    """Runs of three and more single characters."""
    out, run = [], []
    for t in [*tokens, ""]:
        if len(t) == 1 or (t and len(core(t)) == 1):
            run.append(t)
        else:
            if len(run) > 2:
                out.append(run)
            run = []
    return out


# --- the classifier --------------------------------------------------------------------------------


def _features(word: str) -> list[str]:
    """A word and its beginnings, each a kind of its own."""
    return [f"={word}"] + [word[:n] for n in (3, 4, 5, 6, 7) if len(word) > n]


def _lower_bound(k: float, n: float, z: float = 2.0) -> float:
    """Wilson's lower confidence bound of k out of n."""
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _chance(k: int, n: int, base: float) -> float:
    """Chernoff's bound of the chance that k or more out of n are toxic where the share is ``base``."""
    p = k / n
    if p <= base:
        return 1.0
    return math.exp(-n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0)))


def _evidence(docs: list[np.ndarray], labels: np.ndarray, names: int, least: float = 0.35) -> np.ndarray:
    """Lower bounds of the features that are toxic beyond what chance gives among so many features, 0 for others."""
    flat = lambda some: np.bincount(np.concatenate([np.zeros(0, np.int32), *some]), minlength=names)
    total, toxic = flat(docs), flat([d for d, y in zip(docs, labels, strict=True) if y])
    base, tried = max(1, labels.sum()) / max(2, len(labels)), (total > 1).sum()
    out = np.zeros(names)
    for f in np.nonzero(toxic > 1)[0]:
        k, n = int(toxic[f]), int(total[f])
        b = _lower_bound(k, n)
        if b >= least and _chance(k, n, base) * tried < 0.5:
            out[f] = b
    return out


def _summary(evidence: list[float], words: int) -> list[float]:
    """Strongest evidence, how many distinct words are likelier toxic than not, what all evidence adds up to, and the length."""
    found = [e for e in evidence if e > 0]
    strong = [e for e in found if e >= 0.5]
    return [max(found, default=0.0), math.log1p(len(strong)), math.log1p(sum(found)), math.log1p(sum(found) * 200 / (words + 50)), math.log1p(words) / 10]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights with the intercept last, by Newton's method. One class only gives a constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = -4.0 if not len(y) or y[0] == 0 else 4.0
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _narrow(letters: str) -> str:
    return _RUN.sub(r"\1", letters)


class Scores(dict):
    """Evidence of lower-case tokens, remembered; -1 for those without that may be the beginning of a parted word.

    Whatever is decoded keeps its letters but for the length of runs, so letters are compared with runs
    narrowed to one: ``whole`` holds the features, ``heads`` their beginnings.
    """

    def __init__(self, model: np.ndarray, evidence: dict[str, float], most: int = 100_000):
        super().__init__()
        self.model, self.evidence, self.most = model, evidence, most
        self.whole = {_narrow(f.lstrip("=")) for f in evidence}
        self.heads = {f[:n] for f in self.whole for n in range(len(f))}
        self.lengths = sorted(set(map(len, self.whole)))

    def of(self, word: str) -> float:
        return max(map(self.evidence.get, _features(word), [0.0] * 6)) if word else 0.0

    def grown(self, begun: set[str], fragment: str) -> tuple[set[str], bool]:
        """What beginnings of features become by the readings of a fragment, and whether one becomes a feature."""
        for readings in lattice(fragment):
            longer = {_narrow(b + letters) for b in begun for letters, _ in readings}
            if not longer.isdisjoint(self.whole):
                return set(), True
            begun = longer & self.heads
        return begun, False

    def __missing__(self, token: str) -> float:
        if len(self) >= self.most:
            self.clear()
        low, e = core(token), 0.0
        if low.isalpha():
            flat = _narrow(low)
            if any(flat[:n] in self.whole for n in self.lengths):
                e = self.of(restore(low, self.model))
            elif flat in self.heads:
                e = -1.0
        elif low:
            e = self.of(restore(low, self.model)) or -1.0 * bool(self.grown({""}, low)[0] - {""})
        self[token] = e
        return e

    def parted(self, tokens: list[str], found: list[float]) -> list[str]:
        """Words with evidence behind fragments of them: each stretch that may hold one is decoded once, whole.

        A stretch begins where such a word may begin, or with the single characters before that, and takes in
        the short fragments that follow.
        """
        out, done = [], 0
        for i, e in enumerate(found):
            if e >= 0 or i < done:
                continue
            begun, last, hit = self.grown({""}, core(tokens[i]))[0], i, False
            while begun and not hit and last + 1 < len(tokens):
                last += 1
                begun, hit = self.grown(begun, part(tokens, last))
            if not hit:
                continue
            first = i
            while first > done and len(tokens[i]) == len(tokens[first - 1]) == 1:
                first -= 1
            while last + 1 < len(tokens) and len(core(tokens[last + 1])) <= FRAGMENT:
                last += 1
            done = last + 1
            out += [w for w in restore_stretch(tokens[first:done], self.model) if self.of(w) > 0]
        return out


class _Originals:
    """Tells sets that share ``shared`` of ``places`` minimum hashes with an earlier one: copies are no independent witnesses."""

    def __init__(self, places: int = 6, shared: int = 2):
        self.salts, self.shared = np.random.default_rng(5).integers(1, 1 << 63, places, np.uint64) | np.uint64(1), shared
        self.first: dict[tuple[int, int], list[int]] = {}
        self.count = 0

    def add(self, hashes: np.ndarray) -> bool:
        keys = [(k, int((mix(hashes * salt)).min())) for k, salt in enumerate(self.salts)]
        met = Counter(j for key in keys for j in self.first.get(key, ()))
        if max(met.values(), default=0) >= self.shared:
            return False
        for key in keys:
            self.first.setdefault(key, []).append(self.count)
        self.count += 1
        return True


def fit(sample: Iterable[tuple[str, int]], model: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
    """Evidence of features, and weights of the regression, which is fitted across two halves of the originals.

    Texts are taken one at a time and kept as numbers of their words only.
    """
    names: dict[str, int] = {}
    words: dict[str, int] = {}
    raw: dict[str, int] = {}
    of_word: list[np.ndarray] = []
    hashes: list[int] = []
    originals, docs, many, labels = _Originals(), [], [], []
    for text, y in sample:
        tokens = text.lower().split()
        distinct = set(tokens)
        for run in spelled(tokens):
            distinct.update(restore_stretch(run, model))
        for t in distinct:
            if t in raw:
                continue
            w = restore(t, model)
            if w and w not in words:
                words[w] = len(of_word)
                of_word.append(np.array([names.setdefault(f, len(names)) for f in _features(w)], np.int32))
                hashes.append(zlib.crc32(w.encode("utf-8", "surrogatepass")))
            raw[t] = words[w] if w else -1
        own = np.unique(np.fromiter((raw[t] for t in distinct), np.int32))
        own = own[own >= 0]
        if len(own) and originals.add(mix(np.array([hashes[i] for i in own], np.uint64))):
            docs.append(own)
            many.append(len(tokens))
            labels.append(y)
    features = [np.unique(np.concatenate([of_word[i] for i in own])) for own in docs]
    y = np.array(labels, np.int64)
    x = np.zeros((len(docs), 5))
    for half in (0, 1):
        other = _evidence(features[1 - half :: 2], y[1 - half :: 2], len(names))
        best = np.array([other[f].max() for f in of_word]) if of_word else np.zeros(0)
        for i in range(half, len(docs), 2):
            x[i] = _summary(best[docs[i]].tolist(), many[i])
    final = _evidence(features, y, len(names))
    return {f: float(final[i]) for f, i in names.items() if final[i] > 0}, fit_logistic(x, y.astype(float))


def _scorer(model, evidence, weights):
    """Scores of texts; made once in each task."""
    scores = Scores(model.value, evidence.value)

    def score(texts: list[str | None]) -> np.ndarray:
        out = []
        for text in texts:
            tokens = (text or "").lower().split()
            found = list(map(scores.__getitem__, tokens))
            held = {}
            if max(found, default=0.0) > 0:
                held = {restore(t, scores.model): e for t, e in zip(tokens, found, strict=True) if e > 0}
            if min(found, default=0.0) < 0:
                held |= {w: scores.of(w) for w in scores.parted(tokens, found)}
            x = [*_summary(list(held.values()), len(tokens)), 1.0]
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(x, weights)))))))
        return np.array(out)

    return score


def _fitted(documents: DataFrame, labelled: DataFrame, labels: DataFrame):
    context = documents.sparkSession.sparkContext
    model = character_model(documents)
    sample = labelled_sample(labelled, labels, "toxic", FOLDS, HELD_OUT, SAMPLE_ROWS, SAMPLE_CHARS).select("text", "label")
    evidence, weights = fit(sample.toLocalIterator(), model)
    return functools.partial(_scorer, context.broadcast(model), context.broadcast(evidence), weights)


def toxicity(documents: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, held_out, score, predicted; one row per document.

    Fitted on at most SAMPLE_ROWS rows of ``labelled`` that ``labels`` (doc_id, toxic) marks outside the
    held-out fold; labels other than 0 and 1 are ignored. Null and empty texts score like a text without
    words. Rows without doc_id are scored and belong to no fold (held_out false); repeated rows repeat
    their score. Without labels of both classes every score is the same. An empty table gives an empty
    result. Columns other than doc_id and text are not read.
    """
    out = documents.select(F.col("doc_id").cast("long"), score_of(F.col("text"), _fitted(documents, labelled, labels)).alias("score"))
    return out.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns as they are, whose score is below TOXIC; fitted on labelled ones among them."""
    return documents.where(score_of(F.col("text"), _fitted(documents, documents, labels)) < TOXIC)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score; as ``toxicity``."""
    documents = table(spark, sf_dir, "documents")
    return toxicity(documents, documents, table(spark, sf_dir, "labels"))
