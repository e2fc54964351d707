"""Licence families of paragraphs, in DataFrame functions only on the executors.

A sparse logistic regression over word n-grams (1 to 3 words that hold a licence word) gives each paragraph a
family, or `unknown` for licence talk of no known family; its probabilities are calibrated by a temperature
fitted on held-out paragraphs. A family counts only if the paragraph also compares well with a template of it.

The model is trained on the driver on `TRAIN_EACH` generated paragraphs a family and comes to the tasks as one
row of maps (a few hundred KB). Features need a licence word (`ANCHORS`): a paragraph that has none as a word of its own
has no evidence and gets no row, and every other paragraph gets one.

Defined cases: a null or empty text has no paragraphs; paragraphs are the lines of the text, read whole; repeated
rows are scanned each; an empty table gives an empty result; other columns are carried only if asked for.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: Public wording of each family, as found in notices and headers (fixed values).
TEMPLATES = {
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-2-Clause"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 public domain dedication."],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."],
}
#: Talk with licence words that is no notice.
TALK = ["the driving licence was taken away last year", "you need a permission of your parents to go", "he was licensed as a pilot", "a public library in the city", "the software license market grew by five percent", "copyright law is a matter of debate", "the warranty of the car has expired", "an open source conference", "the apache helicopter landed", "gnu and mit are short words", "students of mit won the price", "we ask for your permission", "free software is a matter of liberty", "the terms of the contract were harsh", "her fishing license expired", "custom terms apply to this license"]
#: Words of which a feature holds at least one; a paragraph with none of them is not scored.
ANCHORS = ("license", "licence", "licensed", "licenses", "license-identifier", "spdx-license-identifier", "copyright", "permission", "redistribution", "redistribute", "gnu", "gpl", "lgpl", "agpl", "affero", "apache", "apache-2.0", "mit", "bsd", "mozilla", "mpl", "mpl-2.0", "cc", "cc0", "by-nc", "by-sa", "creative", "commons", "rights", "warranty", "public", "terms")
TRAIN_EACH, HELD_OUT_EACH, SEED = 60, 20, 11
MIN_PROBABILITY, MIN_TEMPLATE = 0.5, 0.5
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: Where a word begins like an anchor: a search that finds all texts with an anchor, and some without.
BEGINS = "(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(dict.fromkeys(re.escape(a[1:]) for a in ANCHORS if a[0] == c))})" for c in sorted({a[0] for a in ANCHORS})) + ")"
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower(), re.ASCII)


def grams_of(words: list[str]) -> list[str]:
    """Distinct n-grams of one to three words that hold an anchor."""
    found = dict.fromkeys(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if any(w in ANCHORS for w in words[i : i + n]))
    return list(found)


def bigrams_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def example(rnd: random.Random, family: str) -> str:
    """A generated paragraph: a template, whole or a long part of it, or talk, with foreign words around."""
    filler = lambda: " ".join("".join(rnd.choice(("the", "an", "er", "ing", "ou", "tion")) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, 6)))
    if family == UNKNOWN:
        w = rnd.choice(TALK).split()
        if rnd.random() < 0.3:
            w = [rnd.choice(ANCHORS) if rnd.random() < 0.3 else x for x in w]
    else:
        w = rnd.choice(TEMPLATES[family]).split()
        if len(w) > 8 and rnd.random() < 0.5:
            w = w[: rnd.randint(len(w) * 2 // 3, len(w))]
        w = [x for x in w if rnd.random() > 0.03]
    return f"{filler() if rnd.random() < 0.4 else ''} {' '.join(w)} {filler() if rnd.random() < 0.4 else ''}".strip()


class Model:
    """Weights by feature, bias and temperature; one column a family."""

    def __init__(self, weights: dict[str, np.ndarray], bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def probabilities(self, text: str) -> np.ndarray:
        z = self.bias + sum((self.weights[g] for g in grams_of(words_of(text)) if g in self.weights), np.zeros(len(FAMILIES)))
        z = np.exp((z - z.max()) / self.temperature)
        return z / z.sum()


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    """Proximal gradient descent on the softmax loss with an L1 penalty, then a temperature from held-out examples."""
    rnd = random.Random(SEED)
    draw = lambda n: [(k, grams_of(words_of(example(rnd, f)))) for k, f in enumerate(FAMILIES) for _ in range(n * (4 if f == UNKNOWN else 1))]
    data, held = draw(TRAIN_EACH), draw(HELD_OUT_EACH)
    place: dict[str, int] = {}
    for _, g in data:
        for x in g:
            place.setdefault(x, len(place))

    def matrix(rows):
        x = np.zeros((len(rows), len(place)))
        for i, (_, g) in enumerate(rows):
            x[i, [place[k] for k in g if k in place]] = 1
        return x, np.eye(len(FAMILIES))[[k for k, _ in rows]]

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = matrix(data)
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(300):
        d = softmax(x @ w + b) - y
        b -= 0.3 * d.mean(axis=0)
        w -= 2.0 * x.T @ d / len(x)
        w = np.sign(w) * np.maximum(np.abs(w) - 2.0 * 2e-4, 0)
    hx, hy = matrix(held)
    z = hx @ w + b
    loss = lambda t: -np.log(np.maximum((softmax(z / t) * hy).sum(axis=1), 1e-12)).mean()
    temperature = float(min((t / 20 for t in range(4, 60)), key=loss))
    used = {g: w[k].round(6) for g, k in place.items() if np.abs(w[k]).max() > 1e-3}
    return Model(used, b.round(6), temperature)


def template_share(words: list[str], family: str) -> float:
    """The larger share of a template's word pairs, or of the paragraph's, that both have."""
    own, best = set(bigrams_of(words)), 0.0
    for t in TEMPLATES.get(family, ()):
        other = set(bigrams_of(words_of(t)))
        both = len(own & other)
        best = max(best, both / len(other), both / len(own) if len(own) > 3 else 0.0) if own else best
    return best


def _ngrams(words: Column, n: int) -> Column:
    parts = [F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - (n - 1), F.lit(0))) for k in range(n)]
    return parts[0] if n == 1 else F.transform(F.arrays_zip(*(p.alias(f"w{k}") for k, p in enumerate(parts))), lambda z: F.concat_ws(" ", *(z[f"w{k}"] for k in range(n))))


def model_row(spark, model: Model) -> DataFrame:
    """The model as one row: feature weights, bias, and the word pairs of each template."""
    schema = T.StructType([
        T.StructField("weights", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
        T.StructField("templates", T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.StringType())))),
    ])
    templates = {f: [bigrams_of(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()} | {UNKNOWN: []}
    return spark.createDataFrame([({g: w.tolist() for g, w in model.weights.items()}, templates)], schema)


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per paragraph with licence words: the columns `keep`, its place, family, probability, template share.

    `family` is `unknown` where the best family is not probable enough or no template of it confirms it.
    """
    names = ["paragraph", "family", "probability", "template_share"]
    if taken := {c.lower() for c in keep} & set(names):
        raise ValueError(f"kept columns clash with results: {sorted(taken)}")
    model = trained()
    own = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)), text_of(f"`{text}`").alias("whole"))
    lines = rows.filter(F.rlike("whole", F.lit(BEGINS))).select(*own, F.posexplode(F.split("whole", "\n")).alias("paragraph", "line")).filter(F.rlike("line", F.lit(BEGINS)))
    words = lines.select(*own, "paragraph", F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    words = words.filter(F.arrays_overlap("words", F.array(*(F.lit(a) for a in ANCHORS))))
    anchored = rf"(^| )({'|'.join(re.escape(a) for a in ANCHORS)})( |$)"
    grams = F.array_distinct(F.filter(F.concat(*(_ngrams(F.col("words"), n) for n in (1, 2, 3))), lambda g: F.rlike(g, F.lit(anchored))))
    pairs = F.array_distinct(_ngrams(F.col("words"), 2))
    found = words.select("*", grams.alias("grams"), pairs.alias("pairs")).crossJoin(F.broadcast(model_row(df.sparkSession, model)))  # one row
    evidence = F.filter(F.transform("grams", lambda g: F.try_element_at("weights", g)), lambda w: w.isNotNull())
    bias = F.array(*(F.lit(float(b)) for b in model.bias))
    scored = found.select("*", F.aggregate(evidence, bias, lambda z, w: F.zip_with(z, w, lambda a, b: a + b)).alias("z"))
    scored = scored.withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, z: s + F.exp((z - F.col("top")) / model.temperature))
    best = F.element_at(F.array(*(F.lit(f) for f in FAMILIES)), F.array_position("z", F.col("top")).cast("int"))
    scored = scored.withColumn("best", best).withColumn("probability", 1 / total)
    both = lambda t: F.size(F.array_intersect(t, F.col("pairs")))
    share = F.array_max(F.transform(F.element_at("templates", F.col("best")), lambda t: F.greatest(both(t) / F.size(t), F.when(F.size("pairs") > 3, both(t) / F.size("pairs")).otherwise(0.0))))
    scored = scored.withColumn("share", F.coalesce(share, F.lit(0.0)))
    sure = (F.col("probability") >= MIN_PROBABILITY) & (F.col("share") >= MIN_TEMPLATE)
    return scored.select(
        *(F.col(o).alias(c) for o, c in zip(own, keep)),
        F.col("paragraph").cast("long").alias("paragraph"),
        F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"),
        F.round("probability", 4).alias("probability"),
        F.round("share", 4).alias("template_share"),
    )
