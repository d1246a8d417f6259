"""Licence notices: a trained paragraph classifier, confirmed by comparison with templates.

The model is fitted on the driver from the templates below and a bounded sample of paragraphs. The scan
itself is native: DataFrame functions only.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices, headers and the telling paragraphs of full texts, by family and version (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under GPL-2.0.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under GPL-3.0.",
    ),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "Proprietary": ("All rights reserved.", "No part of this publication may be reproduced without prior written permission."),
}
UNKNOWN = "unknown"
WORDS = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Paragraphs of the background sample, and the share of them that may hold a word of the vocabulary.
BACKGROUND_ROWS = 4_000
MAX_BACKGROUND_SHARE = 0.005
#: Share of a paragraph's word pairs, or of the template's, that must agree; and how many pairs, if the smaller side has them.
MIN_SIMILARITY, MIN_PAIRS = 0.5, 2
#: Lines of this many characters that do not end a sentence are taken as wrapped: the next line goes on with them.
WRAPPED = (50, 100)
#: Words of each sampled paragraph, at most, that serve as filler around notices.
FILLER_WORDS = 12


def grams(text: str) -> list[str]:
    words = re.findall(WORDS, text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@dataclass
class LicenseModel:
    families: list[str]
    vocabulary: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float
    min_probability: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def holds_template(found: set[str], templates: list[set[str]], min_similarity: float = MIN_SIMILARITY) -> bool:
    """Whether a paragraph's n-grams have two word pairs or more, and that share of a template's, in common with it."""
    return any(len(found & t) >= max(MIN_PAIRS, min_similarity * len(t)) for t in templates)


@dataclass(frozen=True)
class Paragraph:
    """What fitting needs of a sampled paragraph: its n-grams that templates have too, and some of its words."""

    grams: frozenset[str]
    filler: tuple[str, ...]


def fit(background: list[Paragraph], seed: int = 7, copies: int = 60, epochs: int = 400) -> LicenseModel:
    """Multinomial logistic regression on word 1- and 2-grams, with an unknown class from ``background``.

    Each template is repeated with words dropped or added. Words that many background paragraphs use are
    left out of the vocabulary, so that ordinary text has no feature at all and is unknown. Paragraphs that
    hold a template count neither as background nor in that, so a notice's own frequency never removes it; a
    template whose pairs are all ordinary keeps them nevertheless. Half of the
    examples fit the weights; on the other half a temperature is fitted, and the least probability is
    set above all but a thousandth of the unknown ones.
    """
    rnd = random.Random(seed)
    families = [UNKNOWN, *TEMPLATES]
    template_pairs = [{g for g in grams(t) if " " in g} for texts in TEMPLATES.values() for t in texts]
    background = [p for p in background if not holds_template(p.grams, template_pairs)]
    seen: dict[str, int] = {}
    for p in background:
        for g in p.grams:
            seen[g] = seen.get(g, 0) + 1
    known = {g for texts in TEMPLATES.values() for t in texts for g in grams(t)}
    limit = max(5.0, MAX_BACKGROUND_SHARE * len(background))
    rare = {g for g in known if seen.get(g, 0) <= limit or "licen" in g}
    names = sorted(rare.union(*(t for t in template_pairs if not t & rare)))
    index = {g: i for i, g in enumerate(names)}
    filler = [w for p in background[:200] for w in p.filler] or ["of"]
    rows, y = [], []
    for k, texts in enumerate(TEMPLATES.values(), 1):
        for text in texts:
            words = text.split()
            for c in range(copies):
                kept = [w for w in words if c == 0 or rnd.random() > 0.15]
                extra = rnd.choices(filler, k=rnd.randrange(0, 12) if c else 0)
                cut = rnd.randrange(0, len(extra) + 1)
                rows.append(set(grams(" ".join(extra[:cut] + kept + extra[cut:]))))
                y.append(k)
    license_pairs = {g for g in known if " " in g}
    plain = [set(p.grams) for p in background if len(license_pairs & p.grams) < 2]
    lone_words = [g for g in names if " " not in g]
    single = [{*rnd.choices(filler, k=8), rnd.choice(lone_words)} for _ in range(600)]
    rows += plain + single
    y += [0] * (len(plain) + len(single))
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, -1] = 1
    for i, found in enumerate(rows):
        x[i, [index[g] for g in found if g in index]] = 1
    y = np.array(y)
    order = np.random.default_rng(seed).permutation(len(rows))
    fitted, held = order[::2], order[1::2]
    w = np.zeros((x.shape[1], len(families)))
    target = np.eye(len(families))[y]
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        grad = x[fitted].T @ (_softmax(x[fitted] @ w) - target[fitted]) / len(fitted) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    z = x[held] @ w
    losses = {t: -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.5, 2.0, 3.0)}
    temperature = min(losses, key=losses.get)
    p = _softmax(z / temperature)[:, 1:].max(1)
    wrong = p[y[held] == 0]
    least = float(max(0.5, np.quantile(wrong, 0.999))) if len(wrong) else 0.5
    return LicenseModel(families, {g: w[i] for g, i in index.items()}, w[-1], temperature, min(least, 0.9))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, paragraph, text`` of each paragraph; the first has number 0.

    A paragraph is a line with those that wrapped lines go on in, so a notice that is set to some 80 columns is one.
    """
    least, most = WRAPPED
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?", "\n")
    joined = F.regexp_replace(plain, rf"(?m)^([^\n]{{{least - 1},{most - 1}}}[^\n.:;!?\s])[ \t]*\n(?=[^\n])", "$1 ")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(joined, "\n")).alias("paragraph", "text"))


def _known_grams() -> list[str]:
    return sorted({g for texts in TEMPLATES.values() for t in texts for g in grams(t)})


def background_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = BACKGROUND_ROWS) -> list[Paragraph]:
    """A bounded sample of paragraphs for the unknown class: in each of ``rows`` hash buckets the smallest hash.

    Hashes of whole paragraphs are compared first, combined before the shuffle; then the chosen paragraphs, whole ones, give
    their n-grams, of which those that templates have reach the driver.
    """
    lines = paragraphs(docs, id_col, text_col).select("text", F.xxhash64("text").alias("h")).filter("text != ''")
    best = lines.groupBy(F.pmod("h", F.lit(rows)).alias("bucket")).agg(F.min("h").alias("h")).select("h")
    chosen = lines.join(F.broadcast(best), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))
    known = F.array(*map(F.lit, _known_grams()))
    found = chosen.withColumn("words", words).select("h", F.array_intersect(F.concat("words", _pairs(F.col("words"))), known).alias("grams"), F.slice("words", 1, FILLER_WORDS).alias("filler"))
    return [Paragraph(frozenset(r["grams"]), tuple(r["filler"])) for r in sorted(found.collect(), key=lambda r: r["h"])]


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w)))


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Licence paragraphs of all whole texts: ``doc_id, paragraph, family, probability, similarity, confirmed``.

    A paragraph without any word of the vocabulary has the unknown class's score and is left out before
    its n-grams are spread; the model (some hundred n-grams) is broadcast. ``similarity`` is the share of
    word pairs that the paragraph and the nearest template of its family have in common, of the smaller
    of both; from ``min_similarity`` on, and with two pairs in common or all that the smaller side has, the prediction is
    confirmed. Null and empty texts have no
    paragraphs with words and give no rows, repeated rows give theirs again, an empty table gives none.
    """
    spark = docs.sparkSession
    k = len(model.families)
    first_words = sorted({g.split(" ")[0] for g in model.vocabulary})
    weights = F.broadcast(spark.createDataFrame([(g, [float(v) for v in w]) for g, w in model.vocabulary.items()], "gram string, weights array<double>"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))
    lines = paragraphs(docs, id_col, text_col).withColumn("words", words)
    lines = lines.filter(F.arrays_overlap("words", F.array(*map(F.lit, first_words))))
    lines = lines.select("doc_id", "paragraph", F.array_distinct("words").alias("singles"), _pairs(F.col("words")).alias("pairs"))
    # Repeated rows must not be added up: each row's n-grams are spread and summed under a number of its own.
    lines = lines.withColumn("__row", F.monotonically_increasing_id())
    spread = lines.select("__row", "doc_id", "paragraph", "pairs", F.explode(F.concat("singles", "pairs")).alias("gram"))
    summed = spread.join(weights, "gram").groupBy("__row").agg(
        F.first("doc_id").alias("doc_id"), F.first("paragraph").alias("paragraph"), F.first("pairs").alias("pairs"),
        *(F.sum(F.get("weights", F.lit(i))).alias(f"z{i}") for i in range(k)),
    )
    z = F.array(*((F.col(f"z{i}") + float(model.bias[i])) / model.temperature for i in range(k)))
    summed = summed.withColumn("z", z).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    summed = summed.withColumn("probability", 1 / total).withColumn("at", F.array_position("z", F.col("top")))
    family = F.element_at(F.array(*map(F.lit, model.families)), F.col("at").cast("int"))
    found = summed.withColumn("family", family).filter((F.col("at") > 1) & (F.col("probability") >= model.min_probability))
    templates = [(f, sorted({g for g in grams(t) if " " in g})) for f, texts in TEMPLATES.items() for t in texts]
    near = F.broadcast(spark.createDataFrame(templates, "family string, template array<string>").groupBy("family").agg(F.collect_list("template").alias("templates")))
    def similarity(t: Column) -> Column:
        common = F.size(F.array_intersect("pairs", t))
        share = F.try_divide(common.cast("double"), F.least(F.size("pairs"), F.size(t)).cast("double"))
        # One shared pair says nothing about a paragraph, unless a template has no other.
        return F.when(common >= F.least(F.lit(MIN_PAIRS), F.size(t)), share).otherwise(0.0)

    share = F.array_max(F.transform("templates", lambda t: F.coalesce(similarity(t), F.lit(0.0))))
    found = found.join(near, "family").withColumn("similarity", share)
    return found.select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= min_similarity).alias("confirmed"))
