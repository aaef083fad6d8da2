"""Operators over documents: brute force, held-out accuracy, round trips and edge cases."""

import itertools
import random
import re
import textwrap
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrid.llm.best_fit_packing import Encoder, best_fit, best_fit_counts, pack, tokenizer_path
from lexgrid.llm.common import TASKS_PER_CORE, WordHashes, shingle_set, table
from lexgrid.llm.components import components
from lexgrid.llm.licence_scan import model, scan
from lexgrid.llm.line_crf import marginals, op4_quality, quality, without_bad
from lexgrid.llm.minhash_dedup import keep_one, near_duplicates
from lexgrid.llm.mixing import OP5_SQL, mix, mixed_documents, schedule
from lexgrid.llm.ring_sharding import ring, shard, walk
from lexgrid.llm.toxicity import CODES, Scores, character_model, decode, lattice, restore, restore_stretch, spelled, toxicity, without_toxic

SF = "/root/testdata/sf0.01"
CLASHING = "score double, node string, label int, size string, bin int, cell string, rank int, g int, _key string"


def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, names that operators use themselves."""
    long_text = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    base = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, base, "en", "a", 5), (2, base, "en", "a", 5), (None, base, None, None, None), (3, None, "en", "b", None), (4, "", "en", "b", 0), (5, " \n\t ", "fr", None, 4), (6, long_text, "en", "b", 9), (7, "one two", "en", "b", 7), (7, "one two", "en", "b", 7), (7, "three", "en", "a", 5), (8, "é" * 50 + "\n" + "x", "fr", "c", 52), (9, "one\vtwo", "en", "c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_components(rows, percent=85):
    words = WordHashes()
    sets = {i: shingle_set(t, words) for i, t in rows}
    posted, pairs = defaultdict(list), []
    for i in sorted(sets):
        shared = Counter(j for x in sets[i].tolist() for j in posted[x])
        for x in sets[i].tolist():
            posted[x].append(i)
        pairs += [(i, j) for j, v in shared.items() if 100 * v >= percent * (len(sets[i]) + len(sets[j]) - v)]
    return {i: (len(sets[i]), c) for i, c in union_find(pairs, sets).items()}


def test_near_duplicates_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(3)
    cloud = " ".join(f"w{i}" for i in range(150)).split()
    for k in range(60):
        copy = list(cloud)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((5000 + k, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_across_chunks(spark, monkeypatch):
    """Groups of many chunks give the same components as one chunk does."""
    from lexgrid.llm import minhash_dedup

    rng, rows = random.Random(5), []
    for g in range(3):
        text = [f"g{g}w{i}" for i in range(80)]
        for k in range(25):
            t = list(text)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(80)] = f"y{rng.random()}"
            rows.append((g * 100 + k, " ".join(t)))
    monkeypatch.setattr(minhash_dedup, "CHUNK", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_on_odd_rows(spark):
    got = near_duplicates(odd_documents(spark)).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 7)}
    assert len(got) == 12 and by[2]["component_id"] == 1 and not by[2]["kept"] and by[3]["n_shingles"] == 0 and by[4]["kept"]
    assert by[9]["component_id"] == 7 and by[6]["kept"]
    nobody = next(r for r in got if r["doc_id"] is None)
    assert nobody["component_id"] is None and nobody["kept"]
    kept = keep_one(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 7, 8]
    assert near_duplicates(odd_documents(spark).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {n: r for n, r in union_find(pairs, range(500)).items() if n in nodes}


# --- classifiers -----------------------------------------------------------------------------------


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = toxicity(docs, docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert got.count() == docs.count()
    toxic = [r for r in rows if r["toxic"] == 1]
    # about one toxic label in fourteen there stands on junk that has lost its toxic words
    assert sum(r["predicted"] for r in toxic) >= 0.75 * len(toxic)
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.96 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.limit(200).collect())


def test_restoring_obfuscated_words(spark):
    lm = character_model(table(spark, "/root/testdata/sf0.1", "documents"))
    for dressed, word in {"m0r0n": "moron", "stuuuupid": "stupid", "l.o.s.e.r": "loser", "$cum": "scum", "p@thetic": "pathetic", "tr@sh!!": "trash", "cl0wn.": "clown", "idiot###": "idiot", "The": "the", "": "", "***": ""}.items():
        assert restore(dressed, lm) == word


def test_restoring_digits_long_tokens_and_double_letters(spark):
    lm = character_model(table(spark, "/root/testdata/sf0.1", "documents"))
    stretched = "".join(c * 12 for c in "stupid")
    for dressed, word in {"1053r": "loser", "1d10000t": "idiot", stretched: "stupid", "stuupid": "stupid", "st'upid": "stupid", "letter": "letter", "will": "will", "нн": "нн"}.items():
        assert restore(dressed, lm) == word, dressed
    for kept in ("https://example.com/l0ser", "jane.d0e@example.org", "2019-2020", "b1234567", "1990s", "3fa85f64-5717-4562"):
        assert restore(kept, lm) == kept


def test_viterbi_against_enumeration():
    """Every path through a small lattice, white space among its edges, costs at least what the decoder's does."""
    model = np.random.default_rng(8).uniform(0.1, 6.0, (64, 64, 64)).astype(np.float32)

    def cost(path):
        x = y = 0
        total = 0.0
        for letters, price in path:
            total += price
            for c in letters:
                total += float(model[x, y, CODES.get(c, 0)])
                x, y = (0, 0) if c == " " else (y, CODES.get(c, 0))
        return total + float(model[x, y, 0])

    for stretch in ("st up 1d", "m0r0n", "a b", "!d!*t", "l 0 s", "bb 8", "x.y z", "нн а", "2024"):
        paths = list(itertools.product(*lattice(stretch)))
        best = min(paths, key=cost)
        assert decode(stretch, model) == "".join(letters for letters, _ in best), stretch


def test_white_space_is_an_edge_of_the_lattice(spark):
    lm = character_model(table(spark, "/root/testdata/sf0.1", "documents"))
    for fragments, words in {"st upid": ["stupid"], "st u pid": ["stupid"], "i d i o t": ["idiot"], "wo rthless": ["worthless"], "dis gusting": ["disgusting"], "cl own": ["clown"], "in the house": ["in", "the", "house"]}.items():
        assert restore_stretch(fragments.split(), lm) == words
    assert "moron" in restore_stretch(list("youareamoron"), lm)
    assert spelled("so i d\n i o  t, a b end".split()) == [["i", "d", "i", "o", "t,", "a", "b"]]


def test_parted_words_are_found_in_texts(spark):
    """The search for fragments that may hold evidence finds what decoding everything would."""
    lm = character_model(table(spark, "/root/testdata/sf0.1", "documents"))
    scores = Scores(lm, {"=stupid": 0.9, "stup": 0.9, "=idiot": 0.9, "idio": 0.9})
    for text, found in {"so st upid, yes": ["stupid"], "an i  d\ni 0 t here": ["idiot"], "stup1d": [], "st ones": [], "s t u p i d and st u pid": ["stupid", "stupid"], "id iom": ["idiom"], "": [], "st": []}.items():
        tokens = text.lower().split()
        evidence = [scores[t] for t in tokens]
        assert scores.parted(tokens, evidence) == found, text
    assert scores["stup1d"] == scores["stuupid"] == scores["st.u.p.i.d"] == 0.9 and scores["stones"] == 0.0 and scores["st"] == -1.0


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = quality(docs, docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 4, 6, 2])
    odds, same = rng.normal(size=sizes.sum()), 0.8
    ends = np.cumsum(sizes)
    good, agree = marginals(odds, ends - sizes, ends, same)
    for s, e in zip(ends - sizes, ends, strict=True):
        n = e - s
        labels = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
        w = np.exp(labels @ odds[s:e] + same * (labels[:, 1:] == labels[:, :-1]).sum(axis=1))
        assert np.allclose(good[s:e], (labels * w[:, None]).sum(axis=0) / w.sum())
        assert np.allclose(agree[s + 1 : e], ((labels[:, 1:] == labels[:, :-1]) * w[:, None]).sum(axis=0) / w.sum())


def test_quality_query_writes_few_files(spark, tmp_path):
    """A start of a store's process, which every file costs, counts an executor's memory twice."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    docs.repartition(100).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    small = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        out = op4_quality(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() <= TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        assert out.count() == docs.count()
    finally:
        for k in small:
            spark.conf.unset(k)


@pytest.mark.parametrize("scorer, keeper, label", [(toxicity, without_toxic, "toxic"), (quality, without_bad, "quality")])
def test_classifiers_on_odd_rows(spark, scorer, keeper, label):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (7, 1), (None, 1), (8, None), (3, 1), (99, 0)], f"doc_id long, {label} int")
    got = scorer(docs, docs, labels).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert scorer(docs, docs, labels.limit(0)).count() == 12
    assert scorer(docs.limit(0), docs, labels).count() == 0
    assert keeper(docs, labels).columns == docs.columns


def test_licence_scan(spark):
    docs = spark.createDataFrame([(1, "Drivers need a license.\nThis work is licensed under a Creative Commons Attribution 4.0 International License."), (2, None), (3, ""), (None, "Released under the MIT License."), (4, "Copyright 2021 Jane. All rights reserved.\nno cue here"), (5, "text " * 20000 + "Licensed under the Apache License, Version 2.0."), (5, "text")], "doc_id long, text string")
    got = {(r["doc_id"], r["paragraph"]): r for r in scan(docs.withColumn("gram", F.lit("x")).withColumn("row", F.lit(1))).collect()}
    assert {k: v["family"] for k, v in got.items()} == {(1, 0): "unknown", (1, 1): "CC-BY", (None, 0): "MIT", (4, 0): "Proprietary", (5, 0): "Apache-2.0"}
    assert got[1, 1]["confirmed"] and not got[1, 0]["confirmed"] and got[None, 0]["similarity"] == 1.0
    assert scan(docs.limit(0)).count() == 0


def plain_paragraphs(text):
    """(first line, lines, text) of the runs of lines up to an empty one or the end of a sentence."""
    out, held, first = [], [], 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        held.append(line)
        ends = re.search(r"[.!?][\"'”’)\]]{0,2}[ \t\r]{0,3}$", line)
        if ends or not line.strip() or i + 1 == len(lines) or not lines[i + 1].strip():
            out.append((first, len(held), "\n".join(held)))
            held, first = [], i + 1
    return out


def test_licence_scan_against_plain_scores(spark):
    from lexgrid.llm.licence_scan import CUES, SURE, TEMPLATES, grams, tokens

    families, weights, bias, temperature = model()
    docs = table(spark, SF, "documents")
    got = {(r["doc_id"], r["paragraph"]): r for r in scan(docs).collect()}
    want = 0
    for doc_id, text in docs.select("doc_id", "text").collect():
        for first, lines, part in plain_paragraphs(text):
            if not re.search(CUES, re.sub(r"\s+", " ", part)):
                continue
            want += 1
            r, held = got[doc_id, first], set(grams(tokens(part)))
            z = (bias + sum(weights[g] for g in held if g in weights)) / temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert r["lines"] == lines and abs(p.max() - r["probability"]) < 1e-6
            assert r["family"] == (families[p.argmax()] if p.max() >= SURE else "unknown")
            shares = [len(held & set(grams(tokens(t)))) / len(set(grams(tokens(t)))) for t in TEMPLATES.get(r["family"], ())]
            assert r["similarity"] == (None if not any(shares) else pytest.approx(max(shares))) and r["confirmed"] == (max(shares, default=0) >= 0.6)
    assert want == len(got) > 0


def test_wrapped_notices_are_one_paragraph(spark):
    from lexgrid.llm.licence_scan import TEMPLATES

    long = [(f, t) for f, ts in TEMPLATES.items() for t in ts if len(t) > 150]
    rows = []
    for i, (_, t) in enumerate(long):
        for k, prefix in enumerate(("", "# ", " * ")):
            rows.append((10 * i + k, "Some code.\n\n" + "\n".join(prefix + x for x in textwrap.wrap(t, 72)) + "\n\nMore code."))
    got = {r["doc_id"]: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (f, t) in enumerate(long):
        for k in range(3):
            r = got[10 * i + k]
            assert (r["family"], r["confirmed"], r["paragraph"]) == (f, True, 2) and r["lines"] >= 2 and r["similarity"] > 0.9, t


def test_other_licences_are_unknown(spark):
    notices = ["Licensed under the Boost Software License.", "Eclipse Public License 2.0", "Released under the Unlicense.", "Licensed under the zlib License.", "Distributed under the terms of the Eclipse Public License, version 2.0.", "This work is licensed under the Boost Software License, version 1.0.", "See the license for details."]
    known = ["Released under the MIT license", "Licensed under the Apache License, Version 2.0", "licensed under GPL version 3", "This code is released under the BSD 3-Clause License.", "All rights reserved."]
    rows = [(i, t) for i, t in enumerate(notices + known)]
    got = {r["doc_id"]: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"family": F.lit("x"), "template": F.lit(1), "similarity": F.lit(0.5), "words": F.lit("w"), "lines": F.lit(2)})).collect()}
    assert [got[i]["family"] for i in range(len(notices))] == ["unknown"] * len(notices)
    assert [got[len(notices) + i]["family"] for i in range(len(known))] == ["MIT", "Apache-2.0", "GPL-3.0", "BSD", "Proprietary"]


# --- mixing, sharding, packing ---------------------------------------------------------------------


def test_mixing_against_sql(spark):
    docs = table(spark, SF, "documents")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, mix(docs).drop("source").collect()))
    assert got == sorted(con.sql(OP5_SQL).fetchall())
    assert all(r[4] <= 2 * r[1] for r in got)


def test_mixing_on_odd_rows(spark):
    docs = odd_documents(spark)
    got = mix(docs).collect()
    assert len(got) == 12
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for rows in by.values():
        assert sum(r["taken"] for r in rows) == int(rows[0]["target"] + 0.5)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = lambda t: len((t or "").split())
    assert sum(words(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mix(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_mix_comes_in_the_order_of_its_schedule(spark, monkeypatch):
    """Every prefix of the mixed table has the shares of the whole; another schedule gives another order."""
    docs = table(spark, SF, "documents")
    size = lambda t: len((t or "").split())
    rows = [(r["doc_id"], r["source"], size(r["text"])) for r in mixed_documents(docs).select("doc_id", "source", "text").collect()]
    whole, total = Counter(), sum(n for *_, n in rows)
    for _, source, n in rows:
        whole[source] += n
    seen, held = Counter(), 0
    for _, source, n in rows:
        seen[source] += n
        held += n
        if held > total / 4:
            assert all(abs(seen[s] / held - whole[s] / total) < 0.06 for s in whole)
    times = {(r["doc_id"], r["source"]): r["first_time"] for r in mix(docs).where("taken > 0").collect()}
    first = list(dict.fromkeys((d, s) for d, s, _ in rows))
    assert [times[k] for k in first] == sorted(times.values())
    from lexgrid.llm import mixing

    monkeypatch.setattr(mixing, "_reversed_bits", lambda x, bits: x)
    assert [r["doc_id"] for r in mixed_documents(docs).select("doc_id").collect()] != [d for d, *_ in rows]


def test_mix_of_repeated_rows_and_white_space(spark):
    """Equal rows are counted, rows that differ elsewhere only are told apart, and cut texts keep their white space."""
    rows = [(1, "a\t b\n\n c d", "s", k // 30) for k in range(60)] + [(k, " x  y\tz ", "t", 0) for k in range(2, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(3)
    got = mix(docs).collect()
    assert len(got) == 78 and sum(r["taken"] for r in got) == sum({r["source"]: int(r["target"] + 0.5) for r in got}.values())
    out = mixed_documents(docs).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in got)
    assert all("a\t b\n\n c d".startswith(r["text"]) for r in out if r["source"] == "s") and {r["extra"] for r in out if r["source"] == "s"} == {0, 1}
    assert all(" x  y\tz ".startswith(r["text"]) for r in out if r["source"] == "t")
    assert sorted(map(tuple, mixed_documents(docs.repartition(5)).collect())) == sorted(map(tuple, out))


def test_schedule_is_even_in_time(spark):
    plan = spark.createDataFrame([(0, 0, 700), (1, 700, 200), (2, 900, 100)], "sid int, first_cell long, needed long")
    rows = sorted((r["time"], r["sid"], r["rank"]) for r in schedule(spark, plan, 1000).collect())
    assert Counter(r[1] for r in rows) == {0: 700, 1: 200, 2: 100}
    for sid, share in ((0, 0.7), (1, 0.2), (2, 0.1)):
        own = [k for k, r in enumerate(rows) if r[1] == sid]
        assert [r[2] for r in rows if r[1] == sid] == list(range(len(own)))
        assert all(abs(n - share * (k + 1)) < 8 for n, k in enumerate(own, 1))


def test_ring_sharding(spark):
    got = shard(odd_documents(spark), shards=5).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 12 and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}[3] == (16, None)
    assert shard(odd_documents(spark).limit(0)).count() == 0


def test_ring_walk_against_one_by_one():
    rng = random.Random(4)
    counts = Counter(rng.randrange(1 << 16) for _ in range(3000))
    at, total = ring(7, 16), sum(counts.values())
    room = [total // 7 + (s < total % 7) for s in range(7)]
    taken, want = Counter(), []
    for place in sorted(counts):
        for rank in range(counts[place]):
            s = next(s for p, s in [*(x for x in at if x[0] >= place), *at] if taken[s] < room[s])
            want.append((place, rank, s, taken[s]))
            taken[s] += 1
    got = [(p, r, s, slot + r - low) for p, low, high, s, slot in walk(counts, 7, 16) for r in range(low, high)]
    assert got == want


def test_ring_deals_many_copies_of_one_row(spark):
    rows = spark.range(0, 30_000, 1, 3).selectExpr("if(id < 25000, 1, id) AS doc_id", "if(id < 25000, 'same', 'x') AS text")
    got = shard(rows, shards=7).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 30_000 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s])) for s in range(7))
    assert Counter(r["doc_id"] for r in got)[1] == 25_000


def test_ring_moves_few_rows_when_a_shard_is_added():
    counts = {p: 1 for p in range(0, 1 << 16, 7)}
    where = lambda n: {p: s for p, _, _, s, _ in walk(counts, n)}
    a, b = where(40), where(41)
    assert sum(a[p] != b[p] for p in a) < 0.5 * len(a)


def check_sequences(rows, size=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    return len(by)


def test_packing_against_the_whole_tokenizer(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    got = pack(docs, tokenizer_path()).collect()
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), set()
    for doc, text in docs.select("doc_id", "text").collect():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want |= {(doc, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    assert check_sequences(got) <= -(-sum(r["length"] for r in got) // 2048) * 1.01 + 1


def test_packing_on_odd_rows(spark):
    docs = odd_documents(spark).repartition(6)
    got = pack(docs, tokenizer_path()).collect()
    check_sequences(got)
    empty = [r for r in got if r["doc_id"] in (3, 4, 5)]
    assert [r["length"] for r in empty] == [1, 1, 1] and {r["ids_crc32"] for r in empty} == {zlib.crc32(b"\0\0\0\0")}
    assert len({r["doc_id"] for r in got}) == 10 and sum(r["doc_id"] == 7 for r in got) == 3
    assert pack(docs.limit(0), tokenizer_path()).count() == 0


def test_packing_joins_what_partitions_leave(spark):
    """3,000 long texts in one partition and as many shorter ones in another: each finds a partner of the other kind."""
    rows = spark.range(0, 6000, 1, 2).selectExpr("id AS doc_id", "repeat('the ', if(id < 3000, 1099, 899)) AS text")
    got = pack(rows, tokenizer_path()).collect()
    assert {(r["doc_id"], r["start"]) for r in got} == {(i, 0) for i in range(6000)}
    assert {r["length"] for r in got} == {1100, 900}
    assert check_sequences(got) == 3000


def test_best_fit_on_counts_makes_as_many_bins():
    rng = np.random.default_rng(1)
    for size, high, n in ((10, 10, 50), (2048, 2048, 3000), (2048, 300, 3000), (2048, 40, 20_000), (100, 60, 1)):
        lengths = rng.integers(1, high + 1, n)
        plan = best_fit_counts(dict(Counter(lengths.tolist())), size)
        seen, places = Counter(), []
        for length in lengths.tolist():
            rank, seen[length] = seen[length], seen[length] + 1
            _, lead, first, each, used = max(r for r in plan.tolist() if r[0] == length and r[1] <= rank)
            places.append((first + (rank - lead) // each, used + (rank - lead) % each * length, length))
        bins = check_sequences([{"sequence_id": b, "offset": o, "length": n} for b, o, n in places], size)
        assert bins == best_fit(lengths, size).max() + 1


def test_encoder_is_exact():
    encode = Encoder(tokenizer_path())
    texts = ["<|endoftext|>x <|ENDOFTEXT|> İstanbul. ŉgo ΣΑΣ. don't DON'T. it's!? a\tb\r\nc  d é. éx café CAFÉ! ß ẞ 3rd 12,5.", "", "\n\n", "A" * 500 + ".", "한국어. Ĳ.ſt ǆ ***x*** x-y_z (a)[b]{c}"]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert array("I", ids).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_fills_the_tightest_bin():
    assert best_fit(np.array([7, 5, 3, 2]), 10).tolist() == [0, 1, 0, 1]
    assert len(set(best_fit(np.array([6, 5, 5, 4]), 10).tolist())) == 2
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 400, 5000)
    bins = best_fit(sizes, 2048)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 2048 and len(fill) <= -(-sizes.sum() // 2048) + 1
