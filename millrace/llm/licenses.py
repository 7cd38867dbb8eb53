"""License scan: a trained paragraph classifier confirmed by templates.

A paragraph is a line with a word; where a line holds no notice, it is read
together with the adjacent lines that a wrapped notice could go on in. Its features are the word n-grams (1 to 3) of
its lower-cased text that the training texts taught; a sparse logistic
regression per family gives scores, calibrated on held-out training paragraphs
(Platt), and the class "unknown" takes what no family is sure of. A prediction
stands when the paragraph also holds a share CONFIRM of the word bigrams of a
template of its family, two at least where the template has them. A notice of
several lines counts at its first. Such a paragraph holds a word of the template's rarer
bigrams; texts without any of those words stay "unknown" unscored.

Trained on the driver from TEMPLATES (varied with a seed) and BACKGROUND_ROWS
paragraphs of documents at most as examples of other text, a bounded sample.

Defined results: a null or empty text has no paragraphs; whole texts are read;
repeated rows are scanned each; with an empty table the background is empty;
further columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import read_table

#: Paragraphs that training sees as other text, at most; documents they come from, about; n-grams taught, at most.
BACKGROUND_ROWS, SAMPLE_DOCS, MAX_FEATURES = 2000, 4000, 4000
SEED, VARIANTS, ROUNDS, NGRAMS = 8, 40, 250, 3
CONFIRM, SURE = 0.5, 0.5
WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]")

#: Short notices of licence families, as commonly written.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.", "Copyright. All rights reserved. Proprietary and confidential."],
}
FAMILIES = list(TEMPLATES)


def ngrams(words: list[str], most: int = NGRAMS) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


def words_of(line: str) -> list[str]:
    return WORD.findall(line.lower())


def needed(n: int) -> int:
    """Bigrams of a template of ``n`` that confirm a paragraph."""
    return max(int(np.ceil(CONFIRM * n)), min(n, 2))


class Classifier:
    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, scale: np.ndarray, shift: np.ndarray, common: dict[str, int]) -> None:
        self.vocabulary, self.weights, self.bias, self.scale, self.shift = vocabulary, weights, bias, scale, shift
        self.templates = {f: [set(zip(w, w[1:])) for w in map(words_of, t)] for f, t in TEMPLATES.items()}
        self.reach = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)
        self.cues = sorted({c for ts in self.templates.values() for t in ts for c in self._needed(t, common)})

    @staticmethod
    def _needed(template: set[tuple[str, str]], common: dict[str, int]) -> set[str]:
        """Words one of which every paragraph with CONFIRM of the template's bigrams holds: the rarest of each bigram but the commonest ones that it could do with."""
        rare = sorted((min(pair, key=lambda w: (common.get(w, 0), -len(w))) for pair in template), key=lambda w: -common.get(w, 0))
        return set(rare[max(0, needed(len(rare)) - 1) :])

    def may_hold(self, lowered: str) -> bool:
        return any(c in lowered for c in self.cues)

    def classify(self, line: str) -> tuple[str, float, float]:
        """(family or "unknown", its probability, template resemblance)."""
        words = words_of(line)
        hits = [self.vocabulary[g] for g in ngrams(words) if g in self.vocabulary]
        if not hits:
            return "unknown", 0.0, 0.0
        raw = self.weights[hits].sum(0) / np.sqrt(len(hits)) + self.bias
        p = 1 / (1 + np.exp(-(self.scale * raw + self.shift)))
        best = int(p.argmax())
        pairs = set(zip(words, words[1:]))
        held = [(len(t & pairs), len(t)) for t in self.templates[FAMILIES[best]]]
        match = max(k / max(1, n) for k, n in held)
        if p[best] < SURE or not any(k >= needed(n) for k, n in held):
            return "unknown", float(p[best]), match
        return FAMILIES[best], float(p[best]), match


def notices(text: str, classifier: Classifier) -> tuple[int, list[tuple[int, str, float, float]]]:
    """The number of lines with a word, and (line, family, probability, resemblance) of each notice; lines count from 0 without blank ones."""
    lines, run_of, run = [], [], 0
    for x in text.split("\n"):
        if x and not x.isspace():
            lines.append(x)
            run_of.append(run)
        else:
            run += 1
    if not classifier.may_hold(text.lower()):
        return len(lines), []
    cued = [classifier.may_hold(x.lower()) for x in lines]
    alone = [classifier.classify(x) if c else ("unknown", 0.0, 0.0) for x, c in zip(lines, cued)]
    joined = lambda i, j: classifier.classify("\n".join(lines[i : j + 1]))
    found = [(i, *a) for i, a in enumerate(alone) if a[0] != "unknown"]
    free = [a[0] == "unknown" for a in alone]
    # a wrapped notice ends within ``reach`` words after the line it starts in
    for i in range(len(lines)):
        j, words, cue = i, 0, cued[i]
        while free[i] and words < classifier.reach and j + 1 < len(lines) and free[j + 1] and run_of[j + 1] == run_of[i]:
            j += 1
            words += len(words_of(lines[j]))
            cue |= cued[j]
            if not cue or (got := joined(i, j))[0] == "unknown":
                continue
            first = i
            while first + 1 < j and (shorter := joined(first + 1, j))[0] != "unknown":
                first, got = first + 1, shorter
            while j + 1 < len(lines) and free[j + 1] and run_of[j + 1] == run_of[i] and (longer := joined(first, j + 1))[0] != "unknown" and longer[2] > got[2]:
                j, got = j + 1, longer
            free[first : j + 1] = [False] * (j + 1 - first)
            found.append((first, *got))
            break
    return len(lines), sorted(found)


def training_texts(background: list[str], seed: int = SEED) -> list[tuple[str, int]]:
    """(paragraph, family index or -1): templates varied by dropped and added words, and other text."""
    r = random.Random(seed)
    filler = [w for b in background for w in b.split()][:5000] or ["lorem", "ipsum", "dolor", "amet"]
    out = []
    for k, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            for v in range(VARIANTS):
                w = template.split()
                if v % 4 == 1 and len(w) > 8:
                    del w[r.randrange(len(w))]
                if v % 4 >= 2:
                    side = [r.choice(filler) for _ in range(r.randint(1, 12))]
                    w = side + w if v % 4 == 2 else w + side
                out.append((" ".join(w), k))
    out += [(b, -1) for b in background]
    plain = ["the license plate of the car", "a version of the work", "she was licensed to practise", "free of charge for any person", "permission was granted to modify the building", "the general public was permitted", "software version 3 was released", "rights of the people", "under the terms of the treaty", "copies of the book were distributed"]
    out += [(f"{r.choice(filler)} {p} {r.choice(filler)}", -1) for p in plain for _ in range(12)]
    r.shuffle(out)
    return out


def train(background: list[str], seed: int = SEED) -> Classifier:
    """One-against-rest logistic regression with L1 shrinkage, and Platt calibration on a fifth held out."""
    texts = training_texts(background, seed)
    grams = [ngrams(words_of(t)) for t, _ in texts]
    counts: dict[str, int] = {}
    for g, (_, k) in zip(grams, texts):
        if k >= 0:
            for x in g:
                counts[x] = counts.get(x, 0) + 1
    vocabulary = {g: i for i, g in enumerate(sorted(sorted(counts), key=lambda g: -counts[g])[:MAX_FEATURES]) if counts[g] >= 5}
    vocabulary = {g: i for i, g in enumerate(sorted(vocabulary))}
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    for i, g in enumerate(grams):
        hits = [vocabulary[w] for w in g if w in vocabulary]
        if hits:
            x[i, hits] = 1 / np.sqrt(len(hits))
    y = np.array([[k == j for j in range(len(FAMILIES))] for _, k in texts], np.float32)
    held = np.arange(len(texts)) % 5 == 0
    w, b = np.zeros((len(vocabulary), len(FAMILIES)), np.float32), np.full(len(FAMILIES), -2.0, np.float32)
    xt, yt = x[~held], y[~held]
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(xt @ w + b)))
        w -= 8.0 * (xt.T @ (p - yt)) / len(xt) * 4
        w = np.sign(w) * np.maximum(np.abs(w) - 1e-3, 0)
        b -= 2.0 * (p - yt).mean(0)
    raw = x[held] @ w + b
    scale, shift = np.ones(len(FAMILIES)), np.zeros(len(FAMILIES))
    for _ in range(300):
        p = 1 / (1 + np.exp(-(scale * raw + shift)))
        scale -= 0.2 * ((p - y[held]) * raw).mean(0)
        shift -= 0.2 * (p - y[held]).mean(0)
    common: dict[str, int] = {}
    for line in background:
        for word in words_of(line):
            common[word] = common.get(word, 0) + 1
    return Classifier(vocabulary, w, b, np.maximum(scale, 0.1), shift, common)


def background_of(docs: DataFrame, rows: int = BACKGROUND_ROWS) -> list[str]:
    """The paragraphs of smallest hash that name no licence, from about SAMPLE_DOCS documents of smallest hash: a bounded sample, the same at every run."""
    n_docs = docs.count()
    bound = int(2**64 * min(1.0, SAMPLE_DOCS / max(n_docs, 1))) - 2**63  # hashes range from -2**63 on
    some = docs.filter(F.xxhash64("text") <= F.lit(bound)) if n_docs > SAMPLE_DOCS else docs
    lines = some.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).filter("length(line) between 10 and 400")
    plain = lines.filter(~F.lower("line").rlike("licen[sc]e|copyright|permission|redistribut|spdx|rights reserved|creative commons"))
    return [r[0] for r in plain.select("line").orderBy(F.xxhash64("line"), "line").limit(rows).collect()]


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """One row per document: n_paragraphs, n_licensed, families (line:family, joined), top (most frequent), confidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                n_lines, found = notices(text, classifier)
                names = [f for _, f, _, _ in found]
                top = min(set(names), key=lambda f: (-names.count(f), f)) if names else "unknown"
                rows.append((n_lines, len(found), ",".join(f"{i}:{f}" for i, f, _, _ in found), top, max((round(p, 4) for _, _, p, _ in found), default=0.0)))
            n, k, families, top, p = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(families, pa.string()), pa.array(top, pa.string()), pa.array(p, pa.float64())], ["doc_id", "n_paragraphs", "n_licensed", "families", "top", "confidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_paragraphs long, n_licensed long, families string, top string, confidence double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, train(background_of(docs)))
