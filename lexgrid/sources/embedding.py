"""Embeddings from a provider: batches, order, widths and retries around any function from texts to vectors.

A provider is ``call(texts, kind) -> [(index, vector)]``; it raises Refused with the status and body of a reply
that is no success, and OSError where there is none. ``hashed`` is one that needs no network.
"""

from __future__ import annotations

import random
import time
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts at failures, waits for the rate and their length, longest text in characters.
ATTEMPTS, WAITS, WAIT, LONGEST = 5, 12, 61.0, 32_000 * 7 // 2
#: Inputs and tokens of a batch, the share of a minute's tokens that a request may use, the window of rates in seconds.
INPUTS, TOKENS, SAFETY, WINDOW = 96, 100_000, 0.85, 60.0
Call = Callable[[list[str], str], list[tuple[int, list[float]]]]


class EmbeddingError(RuntimeError):
    """No vectors, or not those asked for."""


class QuotaExhausted(EmbeddingError):
    """The provider gives no more; a run stops and can resume."""


class Refused(Exception):
    def __init__(self, status: int, body: str = ""):
        super().__init__(f"{status}: {body}")
        self.status, self.body = status, body


def hashed(dimensions: int = 1024) -> Call:
    """Unit vectors of signed word hashes: equal texts are equal, texts without words have the first axis."""

    def call(texts: list[str], kind: str) -> list[tuple[int, list[float]]]:
        out = []
        for i, text in enumerate(texts):
            v = np.zeros(dimensions)
            for word in text.lower().split():
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                v[h // 2 % dimensions] += 1 - 2 * (h & 1)
            norm = np.linalg.norm(v)
            if not norm:
                v[0] = norm = 1.0
            out.append((i, (v / norm).tolist()))
        return out

    return call


def patient(call: Call, texts: list[str], kind: str, sleep: Callable[[float], None] = time.sleep, chance: Callable[[float, float], float] = random.uniform) -> list[tuple[int, list[float]]]:
    """A reply, after retries: failures of transport and server up to ATTEMPTS times with full jitter, a reached rate up to
    WAITS times without costing attempts. Spent quotas and other refusals fail at once."""
    attempt, waits = 1, 0
    while True:
        try:
            return call(texts, kind)
        except Refused as e:
            spent = e.status in (402, 403) or any(w in e.body.lower() for w in ("quota", "insufficient"))
            if spent:
                raise QuotaExhausted(str(e)) from e
            if e.status == 429 and waits < WAITS:
                waits += 1
                sleep(WAIT + chance(0, 5))
                continue
            if e.status < 500 or attempt == ATTEMPTS:
                raise EmbeddingError(str(e)) from e
        except OSError as e:
            if attempt == ATTEMPTS:
                raise EmbeddingError(str(e)) from e
        sleep(chance(0, min(30.0, 2.0 ** (attempt - 1))))
        attempt += 1


def aligned(reply: list[tuple[int, list[float]]], texts: list[str], dimensions: int) -> list[list[float]]:
    """Vectors in the order of their texts, by the index that the provider gives them."""
    if len(reply) != len(texts):
        raise EmbeddingError(f"{len(reply)} vectors for {len(texts)} texts")
    vectors = [list(map(float, v)) for _, v in sorted(reply, key=lambda r: r[0])]
    if wrong := next((len(v) for v in vectors if len(v) != dimensions), None):
        raise EmbeddingError(f"vectors of {wrong} numbers where {dimensions} are due")
    return vectors


def embed_query(text: str, call: Call, dimensions: int = 1024) -> list[float]:
    if not (text or "").strip():
        raise EmbeddingError("a question without text")
    return aligned(patient(call, [text.strip()], "query"), [text], dimensions)[0]


def estimate(text: str) -> int:
    """Tokens of a text, as functions.text.token_estimate says it of columns."""
    return int(len(text) / 3.5) + 1


def batch_budget(requested: int, tokens_per_minute: int, requests_per_minute: int) -> int:
    """Tokens of one request: its share of a minute, with some to spare; no limit of tokens leaves what was asked for."""
    if tokens_per_minute <= 0:
        return requested
    return max(1, min(requested, int(tokens_per_minute / max(1, requests_per_minute) * SAFETY)))


def batches(texts: list[str], inputs: int = INPUTS, tokens: int = TOKENS) -> Iterator[list[str]]:
    """Texts in order, at most ``inputs`` and ``tokens`` to a batch; a longer text goes alone."""
    now, spent = [], 0
    for text in texts:
        n = estimate(text)
        if now and (spent + n > tokens or len(now) >= max(1, inputs)):
            yield now
            now, spent = [], 0
        now.append(text)
        spent += n
    if now:
        yield now


class RateLimiter:
    """Requests and tokens of the last minute; a limit of 0 or less is none."""

    def __init__(self, requests: int, tokens: int):
        self.requests, self.tokens = requests, tokens
        self.sent: deque[tuple[float, int]] = deque()

    def wait(self, tokens: int, now: float) -> float:
        """Seconds until the oldest request leaves the window, 0 if this one may go now; ask again after waiting."""
        while self.sent and now - self.sent[0][0] >= WINDOW:
            self.sent.popleft()
        full = 0 < self.requests <= len(self.sent) or (self.tokens > 0 and sum(n for _, n in self.sent) + tokens > self.tokens)
        if not full:
            return 0.0
        return max(0.0, WINDOW - (now - (self.sent[0][0] if self.sent else now))) + 0.5

    def pace(self, tokens: int, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        """Wait as long as it takes, then count the request. One that is larger than a minute's tokens goes once the window is empty."""
        while (left := self.wait(tokens, clock())) > 0 and self.sent:
            sleep(left)
        self.sent.append((clock(), tokens))


def parts_of(text: str, most: int = LONGEST) -> list[str]:
    """A text in order as parts of at most ``most`` characters, which end behind white space where there is some; blank ones are left out."""
    out, at = [], 0
    while len(text) - at > most:
        end = next((i + 1 for i in range(at + most - 1, at, -1) if text[i].isspace()), at + most)
        out.append(text[at:end])
        at = end
    return [p for p in [*out, text[at:]] if p.strip()]


def joined(vectors: list[list[float]], parts: list[str]) -> list[float]:
    """The unit vector of a text from those of its parts, each weighed by its length; the first one's where they cancel out."""
    if len(vectors) == 1:
        return vectors[0]
    v = np.average(vectors, axis=0, weights=[len(p) for p in parts])
    norm = np.linalg.norm(v)
    return (v / norm).tolist() if norm else vectors[0]


def embed_documents(rows: DataFrame, text: str, provider: Callable[[], Call], dimensions: int = 1024, batch: int = INPUTS, tokens: int = TOKENS, rates: tuple[int, int] | None = None, blank: str = "error", long: str = "error") -> DataFrame:
    """The rows with a column ``embedding``; texts that are null or blank are an error, or null with ``blank="null"``.

    ``provider`` makes the call once in each task, and ``rates`` (requests and tokens a minute) pace each task on its
    own: metered providers get rows of one partition, behind a store of texts already embedded
    (operators.store.pending), as a lost executor repeats its tasks. Texts beyond LONGEST are an error, or embedded whole in
    parts with ``long="parts"``.
    """
    if rates:
        tokens = batch_budget(tokens, rates[1], rates[0])

    @F.pandas_udf("array<float>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call, limiter = provider(), RateLimiter(*rates) if rates else None
        for texts in series:
            out: list[list[float] | None] = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t and t.strip()]
            if blank == "error" and len(at) < len(texts):
                raise EmbeddingError(f"input {next(i for i, t in enumerate(texts) if not (t and t.strip()))} is empty")
            too_long = next((i for i in at if len(texts.iloc[i]) > LONGEST), None)
            if long == "error" and too_long is not None:
                raise EmbeddingError(f"input {too_long} has more than {LONGEST} characters")
            parts = {i: parts_of(texts.iloc[i]) for i in at}
            vectors: list[list[float]] = []
            for asked in batches([p for i in at for p in parts[i]], batch, tokens):
                if limiter:
                    limiter.pace(sum(map(estimate, asked)))
                vectors += aligned(patient(call, asked, "document"), asked, dimensions)
            given = iter(vectors)
            for i in at:
                out[i] = joined([next(given) for _ in parts[i]], parts[i])
            yield pd.Series(out)

    return rows.withColumn("embedding", embed(F.col(text).cast("string")))


def is_certificate_error(error: BaseException | str) -> bool:
    """Whether a failure to connect is about the server's certificate."""
    return "certificate" in str(error).lower()
