"""Hierarchical best-fit packing of tokenised documents into sequences of a fixed length.

Every partition tokenises its documents, cuts those that are too long, and packs the pieces best-fit in
decreasing length. Nearly full bins are final. The pieces of all underfull bins are packed again together,
whatever partitions they come from: they are counted by length, which is one of at most ``size`` levels,
best-fit runs on the counts, and a piece finds its place by its rank among those of its length. There is no
cap on what is carried, and what the driver holds is bounded by the levels.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrid.llm.common import cut, table

SEQUENCE, NEARLY = 2048, 2032
#: Sequences of pieces that are packed together are numbered from here on, above those of any partition.
TOGETHER = 1 << 62
CACHED_CHUNKS = 120_000
_SIGNS, _ID = ".,;:!?*#$%&()[]{}=+/~^_@-", attrgetter("id")
_COLUMNS = ("bin", "final", "doc_id", "piece", "start", "length", "ids_crc32", "offset", "part", "rank")
_SCHEMA = "bin long, final boolean, doc_id long, piece int, start long, length long, ids_crc32 long, offset long, part long, rank long"
_PLACED = ("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of texts as little-endian 32-bit bytes; the dictionary remembers those of chunks.

    The tokenizer never joins characters across white space, nor a letter with signs that follow it (an
    apostrophe apart), so a text's ids are those of its space-separated chunks, and a chunk's those of its
    letters and its tail. Latin letters alone are one word to the tokenizer: normalising them is
    lower-casing, and their bytes go to the merges directly. All else goes through the whole tokenizer.
    Chunks are kept in two generations: a full one stays until the next is full, then it is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = {b: c for b, c in _byte_letters().items() if chr(b) != c}
        self.tails: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():
            return array("I", map(_ID, self.merge(word.lower()))).tobytes()
        if max(word) < "\u0180" and "\u0130" not in word:
            return array("I", map(_ID, self.merge(word.lower().encode().decode("latin-1").translate(self.letters)))).tobytes()
        return self._whole(word)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        head = chunk.rstrip(_SIGNS)
        if not head.isalpha():
            return self._whole(chunk)
        tail = chunk[len(head) :]
        if tail not in self.tails:
            if len(self.tails) >= CACHED_CHUNKS:
                self.tails.clear()
            self.tails[tail] = self._whole(tail)
        return (self.get(head) or self._word(head)) + self.tails[tail]

    def __missing__(self, chunk: str) -> bytes:
        value = self.old.get(chunk)
        if value is None:
            value = self._chunk(chunk)
        if len(self) >= CACHED_CHUNKS:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        self[chunk] = value
        return value

    def __call__(self, texts: list[str]) -> list[bytes]:
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of every item, best-fit decreasing: the fullest bin that still has room, else a new one."""
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b, made = size, made, made + 1
        bins[i] = b
        if room > need:
            free[room - need].append(b)
            mask |= 1 << (room - need)
    return bins


def best_fit_counts(counts: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing over counts of lengths; as many bins as item by item.

    Rows (length, rank, bin, each, used): from that rank on, items of that length go ``each`` at a time into
    bins from ``bin`` on, which hold ``used`` before. Bins of one room are runs, and a length takes whole runs
    but for its last, so there are a few rows a level however many items there are.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    mask = made = 0
    out = []

    def put(room: int, first: int, many: int) -> int:
        if not room or not many:
            return mask
        free[room].append((first, many))
        return mask | 1 << room

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        while n:
            fits = mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                first, many = free[room].pop()
                if not free[room]:
                    mask &= ~(1 << room)
            else:
                room, first, many = size, made, -(-n // (size // length))
                made += many
            each = room // length
            out.append((length, rank, first, each, size - room))
            full = min(many, n // each)
            mask = put(room - each * length, first, full)
            n, rank, first, many = n - full * each, rank + full * each, first + full, many - full
            if n and many:
                mask = put(room - n * length, first, 1)
                n, first, many = 0, first + 1, many - 1
            mask = put(room, first, many)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _settle(rows: dict[str, np.ndarray], nearly: int):
    """Rows with their bins: offsets within bins, which bins are final, ranks of the others' rows by length."""
    order = np.lexsort((rows["start"], rows["bin"]))
    rows = {k: v[order] for k, v in rows.items()}
    first = np.r_[0, np.nonzero(np.diff(rows["bin"]))[0] + 1]
    counts = np.diff(np.r_[first, len(order)])
    before = np.cumsum(rows["length"]) - rows["length"]
    rows["offset"] = before - np.repeat(before[first], counts)
    rows["final"] = np.repeat(np.add.reduceat(rows["length"], first) >= nearly, counts)
    rest = np.nonzero(~rows["final"])[0]
    rest = rest[np.argsort(rows["length"][rest], kind="stable")]
    lengths = rows["length"][rest]
    rows["rank"] = np.zeros(len(order), np.int64)
    rows["rank"][rest] = np.arange(len(rest)) - np.searchsorted(lengths, lengths)
    return rows


def _batch(rows, has_id):
    ids = pa.array(rows["doc_id"], pa.int64(), mask=~has_id) if has_id is not None else pa.array(rows["doc_id"], pa.int64())
    kinds = {"final": pa.bool_(), "piece": pa.int32()}
    return pa.RecordBatch.from_arrays([ids if c == "doc_id" else pa.array(rows[c], kinds.get(c, pa.int64())) for c in _COLUMNS], list(_COLUMNS))


def _first(batches, path: str, size: int, nearly: int):
    """(doc_id, text) -> packed pieces of this partition."""
    encode, part = _encoder(path), TaskContext.get().partitionId()
    docs, sizes, sums = [], [], []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            docs.append(batch.column(0).slice(at, 256))
            for data in encode([t or "" for t in batch.column(1).slice(at, 256).to_pylist()]):
                data += b"\0\0\0\0"
                sizes.append(len(data) // 4)
                sums.extend(map(zlib.crc32, (data[i : i + 4 * size] for i in range(0, len(data), 4 * size))))
    if not sizes:
        return
    total = np.array(sizes, np.int64)
    pieces = -(-total // size)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    ids = pa.chunked_array(docs)
    rows = {"piece": piece, "start": piece * size, "length": np.minimum(size, np.repeat(total, pieces) - piece * size), "ids_crc32": np.array(sums, np.int64)}
    rows["doc_id"] = np.repeat(pc.fill_null(ids, 0).to_numpy(), pieces)
    rows["known"] = np.repeat(pc.is_valid(ids).to_numpy(), pieces)
    rows["bin"] = best_fit(rows["length"], size) + (part << 40)
    rows["part"] = np.full(len(piece), part, np.int64)
    rows = _settle(rows, nearly)
    yield _batch(rows, rows.pop("known"))


def _place(batches, plan: np.ndarray):
    """(doc_id, piece, start, length, ids_crc32, rank) -> the same pieces with their bins and offsets."""
    starts = (plan[:, 0] << 44) + plan[:, 1]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        _, lead, first, each, used = plan[np.searchsorted(starts, (length << 44) + rank, side="right") - 1].T
        at = rank - lead
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(TOGETHER + first + at // each), pa.array(used + at % each * length)], list(_PLACED))


def pack(documents: DataFrame, tokenizer: str, size: int = SEQUENCE, nearly: int = NEARLY) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a closing 0; a null or empty text is that 0 alone. Documents longer than
    ``size`` are cut into pieces of ``size`` ids, the last one shorter; no other document is cut. Rows
    without doc_id and rows that repeat one are packed like any other. Columns other than doc_id and text
    are not read. An empty table gives an empty result. ``tokenizer`` is a file readable on every executor.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    level = cut(rows.mapInArrow(functools.partial(_first, path=tokenizer, size=size, nearly=nearly), _SCHEMA), spread=True)
    rest = level.where("NOT final").drop("bin", "offset")
    counts = cut(rest.groupBy("part", "length").agg(F.count("*").alias("n")))
    plan = best_fit_counts(dict(counts.groupBy("length").agg(F.sum("n")).collect()), size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rest.join(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    placed = ranked.mapInArrow(functools.partial(_place, plan=plan), "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long")
    out = level.where("final").select(*_PLACED).unionByName(placed)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces with their places in sequences of 2048 tokens; as ``pack``."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
