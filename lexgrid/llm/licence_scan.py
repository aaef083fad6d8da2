"""Licence notices in paragraphs: a trained n-gram classifier, confirmed by comparison with templates.

A softmax regression over word 1- to 3-grams tells licence families apart, with a class of its own for prose that
merely speaks of licences and for notices of other licences: the short templates with other names in the place of
theirs. It is trained on the driver from the templates below and their disturbed copies, a training set of fixed
size, and its temperature is calibrated on copies held out. Scoring is DataFrame operations only: paragraphs with a
cue word become n-grams, which meet the weights in a broadcast join (the table's size is fixed by the templates),
and sums per paragraph give probabilities. A prediction is confirmed if the paragraph holds enough of some
template of the predicted family.

A paragraph is a run of lines up to an empty line or one that ends a sentence, so a notice wrapped over lines is one.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.common import cut, table

#: Openings and customary short notices of public licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Released under the Apache 2.0 license."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GPL version 3.", "Released under the GPLv3 license."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "Licensed under the GPL version 2."),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPL license."),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL license."),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "Licensed under the Mozilla Public License, version 2.0."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
}
#: Sentences with cue words that are no notices, for the unknown class.
OTHER = (
    "Drivers must carry a valid license at all times.", "The restaurant lost its liquor license last year.", "A building permit or license is required before work begins.",
    "He studied copyright law at the university.", "The court ruled that the copyright had expired.", "This product comes with a two year warranty on parts.",
    "The licensed electrician inspected the house.", "She applied for a fishing license in March.", "The license plate was found near the river.",
    "Permission was granted by the city council to close the road.", "The software vendor offers a license for each seat.", "The band gave the label a license to print the record.",
    "Redistribution of wealth was the topic of the debate.", "An apache helicopter flew over the valley.", "The gnu is a large antelope of Africa.",
    "Public domain maps are kept in the archive.", "You may copy the key at the front desk.", "The general public was invited to the free concert.",
    "Version 3 of the form must be used from now on.", "All rights of way must be kept clear.", "Creative people in the commons wrote poems.", "Terms of the license are listed in the annex.",
)
#: Other licences, for the unknown class; drawn into the place of a family's own words.
OTHER_NAMES = ("Artistic", "Open Font", "PostgreSQL", "Ruby", "Python", "Common Development", "Vim", "Sleepycat", "OpenSSL", "Academic Free", "Elastic", "Server Side Public", "Business Source", "Commons Clause", "Mulan", "Ms-PL", "WTFPL", "EUPL", "CDDL", "OFL", "company", "city", "vendor", "third party", "standard", "new", "same", "following")
CUES = r"(?i)licen[cs]|copyright|all rights reserved|redistribut|permission|public domain|creative commons|without warrant|\bcc0|\bcc by|\bgpl|\bagpl|\blgpl|\bspdx"
#: Every cue in lower case holds one of these, on whatever lines its words are, so texts without them are passed over by plain search.
CUE_PARTS, CUE_PATTERN = ("licen", "copyright", "reserved", "redistribut", "permission", "domain", "commons", "warrant", "cc0", "gpl", "spdx"), r"cc\s+by"
#: Line ends between paragraphs: after a sentence, before an empty line, after an empty line.
_BREAK = r"(?<=[.!?][\"'”’)\]]{0,2}[ \t\r]{0,3})\n|\n(?=[ \t\r]*(?:\n|$))|(?<=\n[ \t\r]{0,9})\n"
UNKNOWN, CONFIRMED, SURE, SEED = "unknown", 0.6, 0.5, 7
#: Templates of at most so many words come with other names for the unknown class.
SHORT = 14
_TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _disturbed(text: str, rng: random.Random) -> str:
    words = text.split()
    words = [w for w in words if rng.random() > 0.06]
    filler = " ".join(OTHER).split()
    lead = [rng.choice(filler) for _ in range(rng.choice((0, 0, 0, 2, 8, 30)))]
    return " ".join(lead + words + [rng.choice(filler) for _ in range(rng.choice((0, 0, 0, 3, 10, 30)))])


def _renamed(rng: random.Random) -> list[str]:
    """Short templates without the words that only their family has, other names in their place."""
    of: dict[str, set[str]] = {}
    for f, ts in TEMPLATES.items():
        for w in {w for t in ts for w in tokens(t)}:
            of.setdefault(w, set()).add(f.split("-")[0])
    short = [tokens(t) for f, ts in TEMPLATES.items() for t in ts if f != "Proprietary" and len(tokens(t)) <= SHORT]
    return [" ".join(rng.choice(OTHER_NAMES) if len(of[w]) == 1 or w in ("gnu", "cc", "creative", "commons") else w for w in t) for t in short]


@functools.lru_cache(1)
def model() -> tuple[list[str], dict[str, np.ndarray], np.ndarray, float]:
    """Families, n-gram weights, biases and the calibrated temperature."""
    rng = random.Random(SEED)
    families = [*TEMPLATES, UNKNOWN]
    texts = [(t, f) for f, ts in TEMPLATES.items() for t in ts] * 24
    prose = [" ".join(rng.sample(o.split(), len(o.split())) if rng.random() < 0.3 else o.split()) for o in OTHER * 30]
    others = [_disturbed(t, rng) if rng.random() < 0.5 else t for _ in range(20) for t in _renamed(rng)]
    data = [(_disturbed(t, rng) if rng.random() < 0.8 else t, f) for t, f in texts] + [(p, UNKNOWN) for p in prose + others]
    rng.shuffle(data)
    vocabulary = sorted({g for f in TEMPLATES.values() for t in f for g in grams(tokens(t))} | {g for t in OTHER for g in grams(tokens(t))})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(data), len(vocabulary)), np.float32)
    y = np.zeros((len(data), len(families)), np.float32)
    for i, (t, f) in enumerate(data):
        found = {place[g] for g in grams(tokens(t)) if g in place}
        if found:
            x[i, list(found)] = 1
        y[i, families.index(f)] = 1
    fit, held = slice(0, 4 * len(data) // 5), slice(4 * len(data) // 5, None)
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    mw, vw = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 121):
        p = _softmax(x[fit] @ w + b) - y[fit]
        g = x[fit].T @ p / len(p) + 2e-4 * w
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        w -= 0.05 * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.99**step)) + 1e-6)
        b -= 0.5 * p.mean(axis=0)
    z = x[held] @ w + b
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), y[held].argmax(axis=1)] + 1e-9).mean()
    temperature = float(min(np.geomspace(0.3, 6.0, 61), key=loss))
    return families, {g: w[i].astype(float) for g, i in place.items()}, b.astype(float), temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(gram, w) and (gram, family, template, total): both as large as the templates and no larger."""
    families, weights, _, _ = model()
    own = [(g, f, f"{f}/{n}", len(set(grams(tokens(t))))) for f, ts in TEMPLATES.items() for n, t in enumerate(ts) for g in sorted(set(grams(tokens(t))))]
    return spark.createDataFrame([(g, [float(v) for v in w]) for g, w in weights.items()], "gram string, w array<double>"), spark.createDataFrame(own, "gram string, t_family string, template string, total int")


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, paragraph (the number of its first line), lines, words of every paragraph with a cue."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cued_at_all = lambda low: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(c)) for c in CUE_PARTS]) | low.rlike(CUE_PATTERN)
    rows = rows.where(F.exists(F.array(F.lower("text")), cued_at_all))
    parts = rows.select("doc_id", F.split("text", _BREAK).alias("parts"))
    sizes = F.transform("parts", lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))) + 1)
    cued = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("i"), F.regexp_replace(p, r"\s+", " ").alias("text"))), lambda x: x["text"].rlike(CUES))
    each = parts.select("doc_id", sizes.alias("sizes"), F.explode(cued).alias("p"))
    first = F.aggregate(F.slice("sizes", F.lit(1), F.col("p.i")), F.lit(0), lambda a, n: a + n)
    return each.select("doc_id", first.alias("paragraph"), F.element_at("sizes", F.col("p.i") + 1).alias("lines"), F.regexp_extract_all(F.lower("p.text"), F.lit(_TOKEN), 0).alias("words"))


def scan(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, paragraph, lines, family, probability, template, similarity, confirmed.

    One row for every paragraph with a cue word: ``paragraph`` is the number of its first line, from 0, and ``lines``
    how many it has. ``family`` is 'unknown' for those that are no notice of a known family and for predictions less
    likely than SURE; ``probability`` is that of the likeliest class. ``similarity`` is the share of the n-grams of
    the best template of that family that the paragraph holds, null for unknown. Null and empty texts have no
    paragraphs. Rows without or with repeated doc_ids are scanned like others, each giving its own rows. Columns
    other than doc_id and text are not read. An empty table gives an empty result.
    """
    families, _, bias, temperature = model()
    weights, templates = _tables(documents.sparkSession)
    worded = cut(paragraphs(documents).withColumn("row", F.monotonically_increasing_id()))
    many = F.size("words")
    n_grams = lambda n: F.when(many >= n, F.transform(F.sequence(F.lit(1), many - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.array().cast("array<string>"))
    each = worded.select("row", "doc_id", "paragraph", "lines", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), n_grams(1), n_grams(2), n_grams(3)))).alias("gram"))
    key = ("row", "doc_id", "paragraph", "lines")
    scored = each.join(F.broadcast(weights), "gram", "left").groupBy(*key).agg(*[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(families))])
    z = [(F.col(f"s{i}") + F.lit(float(bias[i]))) / F.lit(temperature) for i in range(len(families))]
    ranked = F.array_max(F.array(*[F.struct(z[i].alias("z"), F.lit(f).alias("family")) for i, f in enumerate(families)]))
    total = functools.reduce(lambda a, b: a + b, [F.exp(z[i] - F.col("top.z")) for i in range(len(families))])
    predicted = scored.withColumn("top", ranked).withColumn("probability", F.round(1 / total, 9))
    predicted = predicted.select(*key, F.when(F.col("probability") < SURE, UNKNOWN).otherwise(F.col("top.family")).alias("family"), "probability")
    held = each.join(F.broadcast(templates), "gram").groupBy("row", "t_family", "template", "total").agg(F.count("*").alias("n"))
    held = held.groupBy("row", F.col("t_family").alias("family")).agg(F.max(F.struct((F.col("n") / F.col("total")).alias("similarity"), "template")).alias("best"))
    out = predicted.join(held, ["row", "family"], "left")
    return out.select("doc_id", F.col("paragraph").cast("int").alias("paragraph"), F.col("lines").cast("int").alias("lines"), "family", "probability", F.col("best.template").alias("template"), F.col("best.similarity").alias("similarity"), F.coalesce(F.col("best.similarity") >= CONFIRMED, F.lit(False)).alias("confirmed"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of the documents with a cue word, its licence family and the template that confirms it; as ``scan``."""
    return scan(table(spark, sf_dir, "documents"))
