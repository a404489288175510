"""Licence scan by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line with a word; a line that names no licence alone is read again with the lines
after it, up to JOIN lines or a blank one, as notices are often wrapped. Words are runs of letters or
of digits, so `GPLv3` is two. A paragraph is described by its n-grams of one to three words that hold
a word of MARKS, hashed to BUCKETS. A softmax regression over families and `unknown` is trained on
the driver on a bounded sample (TRAINING rows at most) of notices made from public licence names and
of negatives. Its temperature and the confidence below which a paragraph stays unknown are
calibrated on names, openers and negatives held out as a whole; then it is fitted to the whole sample.
A prediction stands only if a template of its family confirms it: CONFIRM of some template's word
pairs occur in the paragraph, one with an anchor among them.

Paragraphs without an anchor are not scored: no template could confirm them, so this loses nothing. Families outside NAMES and bare names in other
words than OPENERS stay unknown.

Null and empty texts have no paragraphs and no licence. Each row is judged alone, so
repeated rows, ties and copies need no rule; classes that tie go to the first
by name. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.runtime import save

BUCKETS = 1 << 14
CONFIRM = 0.6
#: Lines of a wrapped notice.
JOIN = 3
#: Share of held-out negatives that may pass the confidence bound, and rows of the sample at most.
FALSE, TRAINING = 0.01, 8000

# Fixed public licence names, identifiers and phrases of well-known licence texts.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPL", "AGPL v3", "AGPLv3", "AGPL-3.0-or-later", "Affero GPL"],
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache License", "Apache 2 licence"],
    "Artistic": ["Artistic License 2.0", "Artistic License", "Artistic-2.0"],
    "BSD": ["BSD License", "3-clause BSD license", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "new BSD license", "simplified BSD licence"],
    "Boost": ["Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "Creative Commons Attribution license", "CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial license", "CC BY-NC 3.0"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-4.0", "CC BY-NC-ND 3.0"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0", "CC BY-NC-SA 3.0"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0", "CC BY-ND 3.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike license", "CC BY-SA 3.0"],
    "CC0": ["CC0 1.0 Universal", "CC0 public domain dedication", "CC0-1.0", "CC0 1.0"],
    "EPL": ["Eclipse Public License", "Eclipse Public License, Version 2.0", "EPL-2.0", "Eclipse Public License v1.0"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License", "GPL-3.0", "GNU GPL version 2", "GPL-2.0-or-later", "GPL v3", "GPLv3", "GPLv2", "GNU General Public License v2.0", "GNU GPL"],
    "ISC": ["ISC License", "ISC licence"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL-2.1", "GNU LGPL", "LGPL v3", "LGPLv3", "LGPLv2.1", "LGPL-3.0-or-later"],
    "MIT": ["MIT License", "MIT licence", "MIT License (MIT)", "MIT-style license", "Expat license", "MIT/Expat license"],
    "MPL": ["Mozilla Public License, Version 2.0", "Mozilla Public License", "MPL-2.0", "Mozilla Public License v1.1"],
    "Unlicense": ["Unlicense license", "Unlicense, see unlicense.org"],
    "zlib": ["zlib License", "zlib/libpng License"],
}
#: Names of one word, which count only after words of OPENINGS.
IDS = {"AGPL": ["AGPL"], "CC0": ["CC0"], "EPL": ["EPL"], "GPL": ["GPL"], "ISC": ["ISC"], "LGPL": ["LGPL"], "MIT": ["MIT"], "MPL": ["MPL"], "Unlicense": ["Unlicense"], "zlib": ["Zlib"]}
OPENINGS = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "SPDX-License-Identifier: {}", "License: {}"]
PHRASES = {
    "Apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC0": ["has waived all copyright and related or neighboring rights to this work worldwide"],
    "GPL": ["it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
OPENERS = ["Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This software is distributed under the terms of the {}.", "Available under {}", "The code is published under a {} by its authors.", "SPDX-License-Identifier: {}", "All files here are covered by the {}.", "{}", "Copyright 2019 the authors. Distributed under {}, see the file LICENSE.", "Use of this data is governed by the {}."]
NEGATIVES = [
    "my driver's license expires in {}", "the license plate of the car from {}", "a license to practise medicine in {}", "they asked permission to leave {}", "copyright law was changed in {}", "the MIT campus near {}", "students at MIT in {} built a robot",
    "an apache helicopter over {}", "the general public of {} was invited", "the mozilla foundation met in {}", "all rights reserved, {}", "a public license office in {}", "commons and attribution in {}", "free software was sold in {}",
    "the fishing license costs money in {}", "redistribution of land in {}", "a licence is needed in {}", "copyright {} the authors", "this license is void in {}", "der Mann kam mit {} nach Hause", "mit der Lizenz aus {}", "la licence de pêche de {}",
    "una licencia para {}", "released under pressure in {}", "licensed under the law of {}", "the band released an album in {}", "permission to use the kitchen in {}", "the artistic director of {}", "a boost for software in {}", "the eclipse was seen in {}", "she read the general terms of {}",
    "the creative commons of {} met", "the GNU project began in {}", "an MIT professor in {} has a license", "see the license of {} for details", "the licensed plumber from {}", "a BSD conference in {}", "public domain films from {}",
]
FILLERS = ["Boston", "May", "the old town", "2020", "our school", "some places", "the report", "Berlin"]
ANCHORS = "affero agpl apache artistic attribution boost bsd bsl cc commons copyright domain eclipse epl expat foundation gnu gpl gplv isc lgpl lgplv agplv libpng licence licenced license licensed licenses mozilla mpl noderivatives noncommercial permission permitted redistribution released sharealike spdx unencumbered unlicense waived zlib".split()
UNKNOWN = "unknown"
FAMILIES = [*sorted(NAMES), UNKNOWN]
ANCHOR_SET = frozenset(ANCHORS)
#: Words that tell families apart beside an anchor, but are too common to look for alone.
MARKS = [*ANCHORS, "mit", "nc", "nd", "sa"]

_WORD = r"\p{L}+|\p{N}+"


def words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+|\d+", text.lower())


def _grams(tokens: list[str], n: int) -> list[str]:
    return [" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


def grams(tokens: list[str]) -> list[str]:
    """N-grams of one to three words with a word of MARKS."""
    return [g for n in (1, 2, 3) for g in _grams(tokens, n) if _marked(g)]


def _bucket(gram: str) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(gram.encode(), seed=42)))) % BUCKETS


def sample() -> list[tuple[str, str, bool]]:
    """The labelled paragraphs in a fixed order, TRAINING at most, and whether each is held out.

    Held out are every fourth name, every fourth opener and every fourth negative as a whole.
    """
    rows = []
    for family, names in NAMES.items():
        for (i, name), (j, opener) in itertools.product(enumerate(names), enumerate(OPENERS)):
            rows.append((family, opener.format(name), i % 4 == 3 or j % 4 == 3))
    for family, names in IDS.items():
        rows += [(family, opening.format(name) + end, j % 4 == 3) for name in names for j, opening in enumerate(OPENINGS) for end in (".", " by its authors")]
    for family, texts in PHRASES.items():
        rows += [(family, f"{before}{text}{after}", k == 3) for text in texts for k, (before, after) in enumerate([("", ""), ("Note: ", ";"), ("You can redistribute it: ", " and so on."), ("", " WITHOUT WARRANTY")])]
    negatives = [(UNKNOWN, text.format(filler), k % 4 == 3) for k, text in enumerate(NEGATIVES) for filler in FILLERS]
    if len(rows) + len(negatives) > TRAINING:
        raise ValueError("the licence sample is larger than TRAINING")
    return rows + negatives


def _fit(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights, bias = np.zeros((x.shape[1], len(FAMILIES))), np.zeros(len(FAMILIES))
    truth = np.eye(len(FAMILIES))[labels]
    for _ in range(300):
        error = _softmax(x @ weights + bias) - truth
        weights -= 4.0 * (x.T @ error / len(x) + 2e-5 * weights)
        bias -= 4.0 * error.mean(axis=0)
    return weights, bias


@functools.cache
def model() -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Weights by bucket, bias, temperature, the confidence bound, and the accuracy on what was held out."""
    rows = sample()
    held = np.array([out for _, _, out in rows])
    labels = np.array([FAMILIES.index(family) for family, _, _ in rows])
    found = [sorted({_bucket(g) for g in grams(words(text))}) for _, text, _ in rows]
    used = sorted({b for f in found for b in f})
    place = {b: i for i, b in enumerate(used)}
    x = np.zeros((len(rows), len(used)), np.float32)
    for i, f in enumerate(found):
        x[i, [place[b] for b in f]] = 1
    weights, bias = _fit(x[~held], labels[~held])
    scores, truth = x[held] @ weights + bias, labels[held]
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(scores / t)[np.arange(held.sum()), truth] + 1e-12).mean())
    sure = _softmax(scores / temperature)[:, :-1].max(axis=1)[truth == len(FAMILIES) - 1]
    bound = float(np.quantile(sure, 1 - FALSE))
    accuracy = float((scores.argmax(axis=1) == truth).mean())
    weights, bias = _fit(x, labels)
    full = np.zeros((BUCKETS, len(FAMILIES)))
    full[used] = weights
    return full, bias, float(temperature), bound, accuracy


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@functools.cache
def templates() -> list[tuple[str, list[str]]]:
    """(family, distinct word pairs) of each template."""
    out = set()
    for family in NAMES:
        # of a name, pairs with a mark: versions alone confirm nothing
        out |= {(family, tuple(sorted(filter(_marked, set(_grams(words(t), 2)))))) for t in NAMES[family]}
        texts = PHRASES.get(family, []) + [o.format(n) for n in IDS.get(family, []) for o in OPENINGS]
        out |= {(family, tuple(sorted(set(_grams(words(t), 2))))) for t in texts}
    return [(family, list(pairs)) for family, pairs in sorted(out)]


def _anchored(gram: str) -> bool:
    return not ANCHOR_SET.isdisjoint(gram.split(" "))


def _marked(gram: str) -> bool:
    return not frozenset(MARKS).isdisjoint(gram.split(" "))


def _ngrams(tokens: Column, n: int) -> Column:
    size = F.size(tokens) - F.lit(n - 1)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(size >= 1, parts).otherwise(F.array().cast("array<string>"))


def _units(docs: DataFrame) -> DataFrame:
    """doc_id, a row number, paragraphs, and the lines with an anchor, each with the wrapped notice it may begin."""
    text = F.coalesce("text", F.lit(""))
    anchor = rf"(?i)(?<!\p{{L}})(?:{'|'.join(ANCHORS)})(?!\p{{L}})"

    def joined(lines: Column, i: Column) -> Column:
        start = F.struct(F.lit(True).alias("open"), F.lit("").alias("out"))
        step = lambda a, x: F.struct((a["open"] & x.rlike(r"\S")).alias("open"), F.when(a["open"], F.concat_ws(" ", a["out"], x)).otherwise(a["out"]).alias("out"))
        return F.aggregate(F.slice(lines, i + 1, JOIN), start, step)["out"]

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("_lines", F.when(F.col("text").rlike(anchor), F.split("text", "\n")).otherwise(F.array().cast("array<string>")))
    placed = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("place"), x.alias("line"))), lambda x: x["line"].rlike(anchor))
    units = F.transform(placed, lambda x: F.struct(x["place"].alias("place"), x["line"].alias("line"), joined(F.col("_lines"), x["place"]).alias("joined")))
    paragraphs = F.regexp_count("text", F.lit(r"(?m)^[^\n]*[^\s][^\n]*$")).cast("long").alias("n_paragraphs")
    return out.select("doc_id", F.monotonically_increasing_id().alias("row"), paragraphs, units.alias("units"))


def _judged(units: DataFrame) -> DataFrame:
    """row, place, wrapped, family and confidence of the paragraphs that a licence is found in. Only their lines move."""
    spark = units.sparkSession
    weights, bias, temperature, bound, _ = model()
    confirming = [(i, family, len(pairs), pair, _anchored(pair)) for i, (family, pairs) in enumerate(templates()) for pair in pairs]
    # both of fixed size: the templates' word pairs, and BUCKETS rows of weights
    confirming = F.broadcast(spark.createDataFrame(confirming, "template int, family string, size int, pair string, anchored boolean"))
    used = np.flatnonzero(weights.any(axis=1))
    table = F.broadcast(spark.createDataFrame([(int(b), weights[b].tolist()) for b in used], "bucket int, w array<double>"))
    key = ["row", "place", "wrapped"]
    each = units.select("row", F.explode("units").alias("u")).select("row", F.col("u.place").alias("place"), F.explode(F.array(F.struct(F.lit(False).alias("wrapped"), F.col("u.line").alias("t")), F.struct(F.lit(True).alias("wrapped"), F.col("u.joined").alias("t")))).alias("v"))
    tokens = F.regexp_extract_all(F.lower(F.col("v.t")), F.lit(_WORD), F.lit(0))
    each = each.select("row", "place", F.col("v.wrapped").alias("wrapped"), tokens.alias("tokens"))
    pairs = each.select(*key, F.explode(F.array_distinct(_ngrams(F.col("tokens"), 2))).alias("pair"))
    met = pairs.join(confirming, "pair").groupBy(*key, "template", "family", "size").agg(F.count(F.lit(1)).alias("n"), F.max("anchored").alias("anchored")).where((F.col("n") >= F.lit(CONFIRM) * F.col("size")) & F.col("anchored"))
    confirmed = save(met.groupBy(*key).agg(F.collect_set("family").alias("families")))
    marked = lambda g: F.exists(F.split(g, " "), lambda x: x.isin(MARKS))
    features = F.array_distinct(F.transform(F.filter(F.concat(*(_ngrams(F.col("tokens"), n) for n in (1, 2, 3))), marked), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))
    scored = each.join(confirmed.select(*key), key, "left_semi").select(*key, F.explode(features).alias("bucket")).join(table, "bucket", "left").groupBy(*key)
    scored = scored.agg(F.array(*(F.sum(F.coalesce(F.get("w", F.lit(k)), F.lit(0.0))) + F.lit(float(b)) for k, b in enumerate(bias))).alias("s"))
    heated = scored.withColumn("e", F.transform("s", lambda s: F.exp((s - F.array_max("s")) / F.lit(temperature))))
    best = heated.select(*key, F.get(F.array(*map(F.lit, FAMILIES)), (F.array_position("e", F.array_max("e")) - 1).cast("int")).alias("family"), (F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, v: a + v)).alias("p"))
    sure = best.where((F.col("family") != UNKNOWN) & (F.col("p") >= F.lit(bound))).join(confirmed, key).where(F.array_contains("families", F.col("family")))
    return sure.select(*key, "family", F.round("p", 4).alias("confidence"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_candidates and `found` (place, family and confidence of each licence) of every row of docs."""
    units = save(_units(docs))
    judged = save(_judged(units))
    alone, wrapped = judged.where(~F.col("wrapped")), judged.where("wrapped")
    # a wrapped notice counts where no line of it names a licence by itself, and once for the lines that begin it
    near = alone.select("row", F.explode(F.sequence(F.col("place") - (JOIN - 1), F.col("place"))).alias("place"))
    wrapped = wrapped.join(near, ["row", "place"], "left_anti")
    before = Window.partitionBy("row", "family").orderBy("place")
    wrapped = wrapped.withColumn("last", F.lag("place").over(before)).where(F.col("last").isNull() | (F.col("place") - F.col("last") >= JOIN)).drop("last")
    found = alone.unionByName(wrapped).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "family", "confidence"))).alias("found"))
    none = F.array().cast("array<struct<place:int,family:string,confidence:double>>")
    return units.join(found, "row", "left").select("doc_id", "n_paragraphs", F.size("units").cast("long").alias("n_candidates"), F.coalesce("found", none).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: paragraphs, those looked at, licences found, their families, and each as family:line."""
    return paragraphs(docs).select(
        "doc_id",
        "n_paragraphs",
        "n_candidates",
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["family"], x["place"].cast("string"))), ",").alias("licenses"),
    )
