"""Licence notices in paragraphs (built-in expressions only on the scanning path).

A logistic regression over sparse n-grams of words is trained on the driver,
on the fixed notices below and on variations of them; unknown is a class of its
own. The probability from which a family is told is calibrated on variations
that were kept apart, so that few unknown paragraphs pass. What is told is then
compared with the family's notices: it is confirmed if it holds most of the
n-grams of one of them.

Paragraphs end at lines without a letter or digit. The lines of a paragraph are
told each alone and all together: notices may be wrapped, or be one line of prose.

Every n-gram with a weight holds a telling word, so paragraphs without such a
word have the bias alone, which means unknown; they are not split into n-grams.

Defined cases: a null or empty text has no paragraph and no licence; documents
without one are still in the result; repeated rows are rows of their own; a
repeated notice counts each time; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices by family.
NOTICES = {
    "AGPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL-3.0."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "This project is released under the Apache 2.0 license."),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 2-Clause License."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC BY-NC 3.0 for noncommercial use."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "CC0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.", "Released under the CC0 1.0 Universal public domain dedication."),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "Released under the GPL-2.0.", "Licensed under the GNU GPL version 2."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies.", "Released under the ISC License."),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL-3.0."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Licensed under the MIT License.", "This software is distributed under the terms of the MIT license."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "Released under MPL-2.0."),
    "Proprietary": ("All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.", "Released under the Unlicense."),
}
# Paragraphs with telling words that name no known licence.
UNKNOWN = (
    "Licensed under the Example Community License, version 1.", "This work is licensed under its own terms.", "Released under a custom license.", "See the license for details.", "A driver's license is required.", "The license was revoked last year.",
    "Copyright law protects authors.", "He asked for permission to leave.", "All rights and duties of the parties are listed below.", "The warranty covers two years.", "The public domain is a legal concept.", "A seat is reserved for you.", "All tables are reserved.",
    "Your copyright notice goes here.", "General terms and conditions of sale.", "The software was distributed on disks.", "The apache helicopter landed.", "MIT is a university in Massachusetts.", "The GNU project began in 1983.", "Mozilla makes a browser.", "The lesser of two evils.", "Creative writing is fun.",
    "The license fee is due each year.", "Redistribution of income was debated.", "The source of the river.", "This permission may be withdrawn.", "Published by the foundation in May.", "Licensed practitioners only.",
)
# Words of which every n-gram with a weight has one.
TELLING = ("license", "licensed", "licence", "licenses", "unlicense", "copyright", "copying", "permission", "permitted", "granted", "warranty", "gnu", "gpl", "lgpl", "agpl", "affero", "lesser", "general", "public", "apache", "bsd", "clause", "isc", "mozilla", "mpl", "creative", "commons", "attribution", "noncommercial", "sharealike", "cc", "cc0", "waived", "domain", "unencumbered", "redistribution", "redistribute", "rights", "reserved", "proprietary", "confidential", "reproduced", "distribute", "publish")
CLASSES = ("unknown", *sorted(NOTICES))
_GAP = r"[^\p{L}\p{N}]+"
GATE = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(TELLING) + r")(?![\p{L}\p{N}])"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def grams_of(words: list[str], longest: int = 3) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


@dataclass
class Model:
    weights: dict[str, list[float]]  # by n-gram, for each class
    bias: list[float]
    least: float  # probability
    templates: list[tuple[str, int, list[str]]]  # family, number, telling n-grams


def _variations(rng: random.Random, text: str, filler: list[str], n: int) -> list[list[str]]:
    """The text's words with some left out and unrelated ones around."""
    words, out = words_of(text), []
    for _ in range(n):
        kept = [w for w in words if rng.random() > 0.06] if len(words) > 8 else list(words)
        before, after = ([rng.choice(filler) for _ in range(rng.choice((0, 0, 3, 15)))] for _ in range(2))
        out.append(before + kept + after)
    return out


def train(seed: int = 7, copies: int = 24, steps: int = 400, penalty: float = 2e-4, false_share: float = 0.01) -> Model:
    """A softmax regression by gradient steps on variations of the notices; deterministic."""
    rng = random.Random(seed)
    filler = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = [(grams_of(v), c) for c, family in enumerate(CLASSES) if c for t in NOTICES[family] for v in _variations(rng, t, filler, copies)]
    rows += [(grams_of(v), 0) for t in UNKNOWN for v in _variations(rng, t, filler, copies)]
    rows += [(grams_of([rng.choice(filler + list(TELLING)) for _ in range(rng.randint(3, 40))]), 0) for _ in range(20 * copies)]
    rng.shuffle(rows)
    telling, count = set(TELLING), {}
    for grams, _ in rows:
        for g in grams:
            if telling.intersection(g.split()):
                count[g] = count.get(g, 0) + 1
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in count.items() if n >= copies // 3))}
    x = np.zeros((len(rows), len(vocabulary) + 1), dtype=np.float64)
    x[:, -1] = 1
    for i, (grams, _) in enumerate(rows):
        x[i, [vocabulary[g] for g in grams if g in vocabulary]] = 1
    y = np.array([c for _, c in rows])
    cut = len(rows) * 3 // 4
    w, m = np.zeros((x.shape[1], len(CLASSES))), np.zeros((x.shape[1], len(CLASSES)))
    goal = np.eye(len(CLASSES))[y[:cut]]
    for _ in range(steps):
        m = 0.9 * m + x[:cut].T @ (goal - _softmax(x[:cut] @ w)) / cut - penalty * w
        w += 1.5 * m
    p = _softmax(x[cut:] @ w)
    wrong = np.sort(p[:, 1:].max(axis=1)[y[cut:] == 0])
    least = max(0.5, float(wrong[int(len(wrong) * (1 - false_share))]) if len(wrong) else 0.5)
    templates = [(family, k, sorted(g for g in grams_of(words_of(t)) if g in vocabulary)) for family in sorted(NOTICES) for k, t in enumerate(NOTICES[family])]
    return Model({g: w[i].round(6).tolist() for g, i in vocabulary.items()}, w[-1].round(6).tolist(), least, templates)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def telling_grams(words: Column, longest: int = 3) -> Column:
    """The distinct n-grams that hold a telling word. words: a column, not an expression, which each n-gram would work out again."""
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*TELLING), i)), lambda i: i.isNotNull())

    def of(n: int) -> Column:
        first = F.filter(F.flatten(F.transform(at, lambda p: F.array(*[p - k for k in range(n)]))), lambda i: (i >= 0) & (i <= F.size(words) - n))
        return F.transform(first, lambda i: F.array_join(F.array(*[F.get(words, i + k) for k in range(n)]), " "))

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in range(1, longest + 1)])))


#: Line ends around one line or more without a letter or digit.
BETWEEN = r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def _units(text: Column) -> Column:
    """(i, line, p) of the paragraphs with a telling word: each whole with null line and, if it has several lines, those of them with such a word."""

    def of(p: Column, i: Column) -> Column:
        lines = F.transform(F.split(p, "\n"), lambda x, k: F.struct(i.alias("i"), k.alias("line"), x.alias("p")))
        whole = F.array(F.struct(i.alias("i"), F.lit(None).cast("int").alias("line"), F.translate(p, "\n", " ").alias("p")))
        return F.when(~p.rlike(GATE), F.array().cast("array<struct<i:int,line:int,p:string>>")).when(F.size(lines) > 1, F.concat(whole, F.filter(lines, lambda x: x["p"].rlike(GATE)))).otherwise(whole)

    return F.flatten(F.transform(F.split(text, BETWEEN), of))


def scan(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", confirm: float = 0.6) -> DataFrame:
    """(uid, doc_id, paragraph, line, body, family, probability, confirmed, told) of each paragraph with a telling word, line being null, and of each such line of those with several lines.

    A document without such a paragraph has one row with null paragraph. told:
    the family if it is probable enough, else unknown; where it holds more of the
    notice of another, as of a shorter one with the same words, that other. The weights, some
    thousand rows whatever the input, are broadcast.
    """
    spark = docs.sparkSession
    weights = spark.createDataFrame([(g, w) for g, w in model.weights.items()], "gram string, w array<double>")
    shown = [(f, k, g, float(len(grams))) for f, k, grams in model.templates for g in grams]
    templates = spark.createDataFrame(shown, "family string, k int, gram string, size double").groupBy("gram").agg(F.collect_list(F.struct("family", "k", "size")).alias("in"))
    table = weights.join(templates, "gram", "left")
    t = F.col("text")
    gated = F.when(t.rlike(GATE), _units(t))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("uid")).select("uid", "doc_id", F.explode_outer(gated).alias("x"))
    rows = rows.select("uid", "doc_id", F.col("x.i").alias("paragraph"), F.col("x.line").alias("line"), F.col("x.p").alias("body"))
    grams = rows.withColumn("words", F.filter(F.split(F.lower("body"), _GAP), lambda w: w != "")).withColumn("gram", F.explode_outer(telling_grams(F.col("words")))).drop("words").join(F.broadcast(table), "gram", "left")
    sums = [F.coalesce(F.sum(F.col("w")[c]), F.lit(0.0)) + model.bias[c] for c in range(len(CLASSES))]
    scored = grams.groupBy("uid", "doc_id", "paragraph", "line").agg(F.first("body").alias("body"), F.array(*sums).alias("z"), F.flatten(F.collect_list("in")).alias("in"))
    best = F.array_max(F.transform("z", lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    scored = scored.withColumn("best", best).withColumn("family", F.element_at(F.array(*map(F.lit, CLASSES)), 1 - F.col("best.i")))
    probability = 1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("best.v")))
    held = F.transform(F.array_distinct("in"), lambda x: F.struct((F.size(F.filter("in", lambda y: (y["family"] == x["family"]) & (y["k"] == x["k"]))) / x["size"]).alias("share"), x["family"].alias("family")))
    scored = scored.withColumn("probability", probability).withColumn("held", held).withColumn("top", F.array_max("held"))
    share = F.array_max(F.transform(F.filter("held", lambda x: x["family"] == F.col("family")), lambda x: x["share"]))
    other = F.coalesce((F.col("top.share") >= confirm) & (F.col("top.share") > F.coalesce(share, F.lit(0.0))), F.lit(False))
    told = F.when((F.col("family") != "unknown") & (F.col("probability") >= model.least), F.when(other, F.col("top.family")).otherwise(F.col("family"))).otherwise("unknown")
    scored = scored.withColumn("told", told).withColumn("confirmed", F.coalesce(share >= confirm, F.lit(False)) | (other & (F.col("told") != "unknown")))
    return scored.select("uid", "doc_id", "paragraph", "line", "body", "family", "probability", "confirmed", "told")


def by_document(scanned: DataFrame) -> DataFrame:
    """One row a document: doc_id, licences (told and confirmed, sorted), n_found, n_unconfirmed, n_unknown, best_probability.

    A paragraph counts as a whole if that finds a family that none of its lines
    does; of its lines then only those count that find one. Otherwise its lines do.
    """
    own = F.collect_list(F.struct("line", "told", "confirmed", "probability"))
    hit = lambda x: (x["told"] != "unknown") & x["confirmed"]
    units = scanned.groupBy("uid", "doc_id", "paragraph").agg(own.alias("units"))
    lines, whole = F.filter("units", lambda x: x["line"].isNotNull()), F.filter("units", lambda x: x["line"].isNull())
    hits = F.filter(lines, hit)
    more = F.filter(whole, lambda x: hit(x) & ~F.array_contains(F.transform(hits, lambda y: y["told"]), x["told"]))
    counted = F.when(F.size(lines) == 0, whole).when(F.size(more) > 0, F.concat(more, hits)).otherwise(lines)
    scanned = units.select("uid", "doc_id", "paragraph", F.inline(counted))
    found = (F.col("told") != "unknown") & F.col("confirmed")
    loose = (F.col("told") != "unknown") & ~F.col("confirmed")
    return scanned.groupBy("uid", "doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("told")))), ",").alias("licences"),
        F.count_if(found).alias("n_found"), F.count_if(loose).alias("n_unconfirmed"), F.count_if(F.col("paragraph").isNotNull() & (F.col("told") == "unknown")).alias("n_unknown"),
        F.round(F.max(F.when(found, F.col("probability"))), 4).alias("best_probability"),
    ).drop("uid")
