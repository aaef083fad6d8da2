"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make a whole signature: the first scatters shingles over D positions, the second is
shifted circularly by one place for each further coordinate (C-MinHash), so coordinate k of a set is
min(pi[sigma(x) + k mod D]). Bands of the signature propose, full shingle sets decide.

How the work stays linear where a third of all rows are copies:

* documents with equal sets are one node from the start (a grouped minimum with partial aggregation);
* buckets and candidate clusters are cut into chunks of a fixed size. Each chunk is compared within, in one
  tile, which gives back a spanning forest and never its pairs; a node travels once;
* only groups of several chunks that still fall into several components compare across chunks, and then nodes
  outside a group's largest component with the rest: what is connected is not compared again;
* shingle sets travel only for nodes that some signature comparison has paired.

A group that is connected after the first step costs its size; one of many unconnected nodes costs their number
times its size, a chunk of each at a time and never in one task.

A pair at Jaccard 0.85 shares no band with probability 8e-7, one at 0.80 with 7e-5, and either falls below
the signature filter with less; there is no cap on buckets or partners. The thin query links from 0.85 on,
stages from 0.80 on.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.common import WordHashes, cut, mix, row_hash, shingle_set, table
from lexgrid.llm.components import components

ROWS_PER_BAND, BANDS = 5, 24
COORDINATES = ROWS_PER_BAND * BANDS
POSITIONS = 1 << 20
CHUNK = 512
#: Nodes with at least this share of all documents are joined by broadcast: there are at most 1 / HOT of them.
HOT = 1 / 1000
#: Ids broadcast to pick the texts of candidates: above this many (16 MB) they are joined by shuffling.
BROADCAST_IDS = 1_000_000


@functools.lru_cache(1)
def _circulant() -> np.ndarray:
    """Row p holds the second permutation from place p on, wrapping: all coordinates of a shingle at p."""
    pi = np.random.default_rng(20240229).permutation(POSITIONS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:COORDINATES]]), COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    rows = _circulant()
    at = (mix(shingles) >> np.uint64(44)).astype(np.int64)
    out = rows[at[:1024]].min(axis=0)
    for i in range(1024, len(at), 1024):
        np.minimum(out, rows[at[i : i + 1024]].min(axis=0), out=out)
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sign(batches):
    words, known = WordHashes(), {}
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        size, node, sig, bands = [], [], [], []
        for text in texts:
            s = shingle_set(text.as_py(), words)
            size.append(len(s))
            if not len(s):
                node.append(None), sig.append(None), bands.append(None)
                continue
            d = _digest(s)
            if d not in known:
                if len(known) > 2000:
                    known.clear()
                v = signature(s)
                rows = np.column_stack([np.arange(BANDS, dtype=np.uint32), v.reshape(BANDS, ROWS_PER_BAND)])
                known[d] = (v & 255).astype(np.uint8).tobytes(), [xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in rows]
            node.append(d)
            sig.append(known[d][0])
            bands.append(known[d][1])
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), batch.column(2), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "node", "sig", "bands"])


def _sets(batches):
    words = WordHashes()
    for batch in batches:
        node, sets = [], []
        for text in batch.column(0):
            s = shingle_set(text.as_py(), words)
            node.append(_digest(s) if len(s) else None)
            sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            over = up[up]
            if np.array_equal(over, up):
                return up
            up = self.up = over


def _link(tile: dict, percent: int, floor: float) -> list[tuple[bytes, bytes]]:
    """Forest of a tile's links that join what labels don't join already. Without sets, links are signatures that agree in ``floor`` of all places."""
    nodes, n, chunk = tile["node"], tile["n"], tile["chunk"]
    m = len(nodes)
    sig = np.frombuffer(b"".join(tile["sig"]), np.uint8).reshape(m, -1)
    cross = len(np.unique(chunk)) > 1
    sets = tile.get("shingles")
    if sets is not None:
        lengths = np.fromiter((len(s) // 8 for s in sets), np.int64, m)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        index = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1]
        flag = np.zeros(int(index.max()) + 1 if len(index) else 1, np.int32)
    forest, out = _Forest(m), []
    if "label" in tile:
        _, first, same = np.unique(np.array(tile["label"], object), return_index=True, return_inverse=True)
        forest.up = first[same]
    for i in range(m - 1):
        roots = forest.roots()
        rest = np.arange(i + 1, m)
        rest = rest[roots[i + 1 :] != roots[i]]
        rest = rest[100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])]
        if cross:
            rest = rest[chunk[rest] != chunk[i]]
        if not len(rest):
            continue
        rest = rest[(sig[rest] == sig[i]).mean(axis=1) >= floor]
        if len(rest) and sets is not None:
            own = index[starts[i] : starts[i + 1]]
            flag[own] = 1
            shared = np.fromiter((flag[index[starts[j] : starts[j + 1]]].sum() for j in rest), np.int64, len(rest))
            flag[own] = 0
            rest = rest[100 * shared >= percent * (n[i] + n[rest] - shared)]
        for j in rest:
            a, b = forest.root(i), forest.root(j)
            if a != b:
                forest.up[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[j]))
    return out


def _tiles(batches, percent: int, floor: float):
    """Sorted rows (g, ti, tj, chunk, node, n, sig[, label][, shingles]) -> edges (a, b) of each tile's forest."""
    held, key = None, None

    def edges(rows):
        return _link(rows | {"n": np.array(rows["n"]), "chunk": np.array(rows["chunk"])}, percent, floor) if len(rows["node"]) > 1 else []

    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        found = []
        keys = list(zip(cols["g"], cols["ti"], cols["tj"], strict=True))
        names = [c for c in cols if c not in ("g", "ti", "tj")]
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            part = {c: cols[c][start:i] for c in names}
            if keys[start] == key:
                for c in names:
                    held[c].extend(part[c])
            else:
                found += edges(held) if held else []
                held, key = part, keys[start]
            start = i
        if found:
            yield _edge_batch(found)
    if held and (found := edges(held)):
        yield _edge_batch(found)


def _edge_batch(found):
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.binary()), pa.array([e[1] for e in found], pa.binary())], ["a", "b"])


def _placed(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select("g", "ti", "tj", "chunk", *keep).repartition("g", "ti", "tj").sortWithinPartitions("g", "ti", "tj", "node")


def _linked(rows: DataFrame, keep: list[str], percent: int, floor: float) -> DataFrame:
    """rows (g, members, node, n, sig[, shingles]) -> components (node, root) of the links within groups ``g``; nodes without links are left out."""
    find = functools.partial(_tiles, percent=percent, floor=floor)
    edges = lambda tiles, cols: tiles.mapInArrow(find, "a binary, b binary")
    part = lambda count, salt: F.pmod(F.xxhash64("g", "node", F.lit(salt)), count).cast("int")
    own = part(F.ceil(F.col("members") / CHUNK), 1)
    within = cut(edges(_placed(rows.withColumns({"ti": own, "tj": own, "chunk": own}), keep), keep))
    found = components(within)
    large = rows.where(F.col("members") > CHUNK)
    if large.isEmpty():
        return found
    named = large.join(found.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("g", "label").agg(F.count("*").alias("size"))
    sizes = cut(sizes.groupBy("g").agg(F.max(F.struct("size", "label")).alias("most"), F.sum("size").alias("all"), F.count("*").alias("labels")).where("labels > 1").select(F.col("g").alias("g_"), F.col("most.label").alias("main"), F.ceil(F.col("most.size") / CHUNK).cast("int").alias("majors"), F.ceil((F.col("all") - F.col("most.size")) / CHUNK).cast("int").alias("minors")))
    if sizes.isEmpty():
        return found
    apart = named.join(sizes, F.col("g") == F.col("g_")).withColumn("major", F.col("label") == F.col("main"))
    other, number = lambda count: F.sequence(F.lit(0), count - 1), F.when(F.col("major"), part(F.col("majors"), 2)).otherwise(part(F.col("minors"), 3))
    apart = apart.withColumn("number", number)
    tile = lambda i, j: F.struct(i.alias("ti"), j.alias("tj"))
    with_minors = F.transform(other(F.col("minors")), lambda k: tile(F.least("number", k), F.greatest("number", k)))
    with_majors = F.transform(other(F.col("majors")), lambda k: tile(F.col("number"), -1 - k))
    tiles = F.when(F.col("major"), F.transform(other(F.col("minors")), lambda k: tile(k, -1 - F.col("number")))).otherwise(F.concat(with_minors, with_majors))
    across = apart.withColumn("t", F.explode(tiles)).withColumns({"ti": F.col("t.ti"), "tj": F.col("t.tj"), "chunk": F.when(F.col("major"), -1 - F.col("number")).otherwise(F.col("number"))})
    return components(within.unionByName(cut(edges(_placed(across, [*keep, "label"]), keep))))


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, text_hash, n_shingles, component_id, kept; one row per document.

    Documents are linked where 100 * intersection >= percent * union of their five-word shingle sets;
    component_id is the smallest doc_id reachable. Null or empty texts have no shingles, are linked with
    nothing and keep their own id. Rows without a doc_id join no component: component_id is null and they
    are kept. Rows that repeat a doc_id are judged by their own texts; equal rows give equal results.
    Columns other than doc_id and text are neither read nor returned. An empty table gives an empty one.
    """
    cols = "doc_id long, text_hash long, n_shingles long, node binary, sig binary, bands array<long>"
    signed = cut(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).mapInArrow(_sign, cols), spread=True)
    nodes = cut(signed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig"), F.max("bands").alias("bands")))
    floor = percent / 100 - 0.2

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = cut(banded.join(shared, "bucket"))
    keep = ["node", "n", "sig"]
    clusters = cut(_linked(met.join(nodes.select(*keep), "node").withColumn("g", F.col("bucket").cast("string")), keep, percent, floor))

    sized = clusters.join(clusters.groupBy("root").agg(F.count("*").alias("members")), "root")
    wanted = cut(sized.join(nodes.select("node", "n", "sig", "first_id"), "node"))
    ids = wanted.select(F.col("first_id").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL AND text IS NOT NULL").join(ids, "doc_id", "left_semi")
    sets = texts.select("text").mapInArrow(_sets, "node binary, shingles binary").dropDuplicates(["node"])
    full = cut(wanted.join(sets, "node"))
    linked = _linked(full.withColumn("g", F.hex("root")), [*keep, "shingles"], percent, floor)

    named = nodes.join(linked.withColumnRenamed("root", "top"), "node", "left").select("node", "first_id", "copies", F.coalesce("top", "node").alias("top"))
    least = named.groupBy("top").agg(F.min("first_id").alias("component_id"))
    found = cut(named.join(least, "top").select("node", "copies", "component_id"))
    rows = signed.select("doc_id", "text_hash", "n_shingles", "node")
    hot = F.broadcast(found.where(F.col("copies") >= F.lit(HOT * rows.count())).select("node", "component_id"))
    some = rows.where("node IS NOT NULL")
    parts = [rows.where("node IS NULL").withColumn("component_id", F.col("doc_id")), some.join(hot, "node"), some.join(hot, "node", "left_anti").join(found.drop("copies"), "node", "left")]
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its component at Jaccard 0.85; as ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("text_hash")


def keep_one(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, all columns as they are, without those that a smaller id of their component stands for.

    Of rows that repeat both id and text of a kept document, the one of the smallest row hash stays. Null and empty
    texts are kept once per id, and all rows without doc_id. An empty table gives an empty one.
    """
    judged = cut(near_duplicates(documents, percent).where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")).where("NOT kept OR rows > 1"))
    small = judged.count() <= BROADCAST_IDS // 2
    side = judged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kept")
    same = lambda other: (F.col("doc_id").cast("long") == other["_id"]) & (F.xxhash64(F.col("text").cast("string")) == other["_hash"])
    sent = lambda some: F.broadcast(some) if small else some
    out = documents.join(other := sent(side.drop("kept")), same(other), "left_anti")
    repeated = side.where("kept")
    if not repeated.isEmpty():
        some = documents.join(other := sent(repeated.drop("kept")), same(other), "left_semi").withColumn("_row", row_hash(documents))
        one = some.groupBy(F.col("doc_id").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash")).agg(F.min_by(F.struct(*[F.col(c) for c in documents.columns]), "_row").alias("_kept"))
        out = out.unionByName(one.select("_kept.*"))
    return out
