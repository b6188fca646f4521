"""Licence scan: a trained paragraph classifier, confirmed against templates.

Lines are joined where a sentence goes on in the next one, so that wrapped notices are read
whole; lines that were joined are read by themselves too. A sentence is classified by
logistic regression on its words and word pairs, a long one in overlapping windows: one
class for each licence family and one for text that is no licence (unknown). The unknown
class is calibrated: a family counts only where its probability, at a temperature fitted on
variants held out, reaches a threshold that lets through none of the held-out corpus
sentences. A prediction is confirmed if some run of words holds enough of the word pairs of
a template of the family, and no other family's template fits better.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import by_text, in_arrow
from pagetables.llm.linear import Sparse, fit

#: Notices and distinctive sentences of common licences, by family.
TEMPLATES = {
    "AGPL": (
        "GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License.",
        "under the Apache License 2.0",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0"),
    "BSD": (
        "Released under the BSD License.",
        "under the BSD 3-Clause License",
        "under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC-BY-NC-ND": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives "
        "4.0 International License."),
    "CC-BY-NC-SA": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
        "International License."),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
        "International License."),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License.",
        "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation.",
        "GNU General Public License Version 3, 29 June 2007",
        "GNU General Public License Version 2, June 1991",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0"),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all copies",
        "SPDX-License-Identifier: ISC"),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "MIT": (
        "Released under the MIT License.",
        "under the MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "SPDX-License-Identifier: MIT"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "under the Mozilla Public License 2.0",
        "Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "SPDX-License-Identifier: MPL-2.0"),
    "Proprietary": (
        "All rights reserved.",
        "No part of this work may be reproduced without permission.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form "
        "or by any means without the prior written permission of the publisher."),
    "Public-Domain": (
        "This work is dedicated to the public domain.",
        "Released under CC0 1.0 Universal.",
        "CC0 1.0 Universal",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "SPDX-License-Identifier: CC0-1.0"),
}
#: Bound of the sample of corpus sentences that stand for text without a licence.
SAMPLE = 4000
#: Variants made from each template for training.
VARIANTS = 24
#: Share of a template's word pairs that a run of words must hold; a template of at most
#: ``PHRASE`` words must be there word for word.
CONFIRM, PHRASE = 0.6, 6
#: Corpus sentences that hold this share of a template take no part in training.
ALIKE = 0.3
#: Words of a window and of the step to the next one; a template has at most their difference.
WINDOW, STEP = 48, 16
#: Windows that are classified together.
TOGETHER = 4096

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NONE = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_ENDS = re.compile(rb"[.!?:;][\"')\]]*\s*$")
_SENTENCE = re.compile(rb"(?<=[.!?:;])\s+(?=[^a-z0-9\s])")


def words(paragraph: bytes) -> list[bytes]:
    return _WORD.findall(paragraph.lower())


def _pairs(w: list[bytes]) -> list[bytes]:
    return [a + b" " + b for a, b in zip(w, w[1:])]


def paragraphs(text: bytes) -> Iterator[list[bytes]]:
    """Lines with a word in them, together with those that a sentence goes on in."""
    open_ = []
    for line in text.split(b"\n"):
        if _NONE.search(line):
            open_.append(line)
            if not _ENDS.search(line):
                continue
        if open_:
            yield open_
        open_ = []
    if open_:
        yield open_


def sentences(lines: list[bytes]) -> Iterator[list[bytes]]:
    """Words of each sentence of a paragraph, and of each line if these are several."""
    for part in _SENTENCE.split(b" ".join(lines)):
        yield words(part)
    if len(lines) > 1:
        for line in lines:
            for part in _SENTENCE.split(line):
                yield words(part)


def windows(w: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of at most WINDOW words; any WINDOW - STEP words in a row lie in one of them."""
    yield w[:WINDOW]
    for at in range(STEP, len(w) - WINDOW + STEP, STEP):
        yield w[at:at + WINDOW]


def _variants(base: list[bytes], n: int, rng: np.random.Generator) -> list[list[bytes]]:
    """A template's words with some dropped, common words put between, and in half of them
    unknown ones around."""
    filler = [b"the", b"of", b"this", b"is", b"and", b"by", b"file", b"project", b"code", b"2020"]
    out = [base]
    for i in range(n - 1):
        w = [x for x in base if len(base) < 4 or rng.random() > 0.08]
        for _ in range(rng.integers(0, 3)):
            w.insert(int(rng.integers(0, len(w) + 1)), filler[int(rng.integers(len(filler)))])
        if i % 2:
            around = int(rng.integers(0, min(3 * len(w), WINDOW)))
            before = int(rng.integers(0, around + 1))
            w = [b""] * before + w + [b""] * (around - before)  # no word is empty
        out.append(w)
    return out


class LicenceModel:
    """Families, template pairs, word and pair numbers, weights, temperature and threshold."""

    def __init__(self, templates: dict[str, tuple[str, ...]], corpus: list[bytes]):
        rng = np.random.default_rng(11)
        self.families = sorted(templates)
        rows, labels, held = [], [], []
        self.templates: list[tuple[int, int, int]] = []  # family, words, pairs
        self.having: dict[bytes, list[int]] = {}
        for i, f in enumerate(self.families):
            for base in (words(t.encode()) for t in templates[f]):
                if not 3 <= len(base) <= WINDOW - STEP:
                    raise ValueError(f"a template has 3 to {WINDOW - STEP} words: {base}")
                for pair in set(_pairs(base)):
                    self.having.setdefault(pair, []).append(len(self.templates))
                self.templates.append((i, len(base), len(set(_pairs(base)))))
                for j, v in enumerate(_variants(base, VARIANTS, rng)):
                    rows.append(v)
                    labels.append(i)
                    held.append(j % 4 == 3)
        self.names = {g: i for i, g in enumerate(sorted(
            {g for r in rows for g in (*r, *_pairs(r)) if g.strip() == g != b""}))}
        none = len(self.families)
        for j, p in enumerate(corpus):
            parts = [w for s in sentences([p]) for w in windows(s) if w]
            if parts:
                w = parts[len(p) % len(parts)]
                if not any(share >= ALIKE for share, _ in self.shares(w).values()):
                    rows.append(w)
                    labels.append(none)
                    held.append(j % 4 == 3)
        self._fit(rows, np.array(labels), np.array(held, bool))

    def features(self, w: list[bytes]) -> tuple[list[int], float, bool]:
        """Numbers of the known words and pairs, the share of words that is unknown, and
        whether there is a known pair."""
        names = self.names
        found = [names[x] for x in w if x in names]
        other = 1 - len(found) / max(len(w), 1)
        if len(found) < 2:
            return found, other, False
        single = len(found)
        found += [names[x] for x in _pairs(w) if x in names]
        return found, other, len(found) > single

    def _sparse(self, feats: list[tuple[list[int], float, bool]]) -> Sparse:
        n = np.array([len(f[0]) for f in feats], np.int64)
        row = np.repeat(np.arange(len(feats)), n)
        col = np.fromiter((c for f in feats for c in f[0]), np.int64, int(n.sum()))
        return Sparse(row, col, (1 / np.sqrt(np.maximum(n, 1)))[row], len(feats), len(self.names),
                      np.array([[f[1]] for f in feats]).reshape(len(feats), 1))

    def _logits(self, x: Sparse) -> np.ndarray:
        return np.stack([x.dot(w) + b for w, b in self.models], axis=1)

    def _fit(self, rows: list[list[bytes]], labels: np.ndarray, held: np.ndarray, l2: float = 1e-5):
        """One class against the others at a time, both halves with the same weight."""
        k = len(self.families) + 1
        x = self._sparse([self.features(r) for r in rows])
        self.models = []
        for c in range(k):
            y = (labels == c).astype(float)
            weight = np.where(y > 0, 1 / max((y * ~held).sum(), 1), 1 / max(((1 - y) * ~held).sum(), 1))
            self.models.append(fit(x, y, weight * ~held, l2))
        z, y = self._logits(x)[held], labels[held]
        self.temperature = min(np.geomspace(0.25, 4, 25), key=lambda t: self._loss(z / t, y))
        none = y == k - 1
        self.threshold = max(0.5, float(self._softmax(z)[none, :-1].max(initial=0)))

    @staticmethod
    def _loss(z: np.ndarray, y: np.ndarray) -> float:
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean()) if len(y) else 0.0

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def shares(self, w: list[bytes]) -> dict[int, tuple[float, int]]:
        """For each family that shares a pair with ``w``: the largest share, and number, of a
        template's pairs in a run of at most twice the template's words."""
        at: dict[int, list[tuple[int, bytes]]] = {}
        for i, pair in enumerate(_pairs(w)):
            for t in self.having.get(pair, ()):
                at.setdefault(t, []).append((i, pair))
        best: dict[int, tuple[float, int]] = {}
        for t, hits in at.items():
            family, size, pairs = self.templates[t]
            inside, first, most = Counter(), 0, 0
            for i, pair in hits:
                inside[pair] += 1
                while i - hits[first][0] > 2 * size - 2:
                    inside[hits[first][1]] -= 1
                    if not inside[hits[first][1]]:
                        del inside[hits[first][1]]
                    first += 1
                most = max(most, len(inside))
            share = most / pairs
            if size <= PHRASE and share < 1:
                share = min(share, ALIKE)  # never confirmed
            best[family] = max(best.get(family, (0.0, 0)), (share, most))
        return best

    def _confirmed(self, family: int, w: list[bytes]) -> bool:
        shares = self.shares(w)
        own = shares.get(family, (0.0, 0))
        return own[0] >= CONFIRM and own == max(shares.values())

    def scan(self, text: bytes) -> tuple[list[str], int, int]:
        """Families confirmed in a text, sorted, the number of its paragraphs, and of those
        that look like a licence without a sentence that a template confirms."""
        found, doubtful, confirmed = set(), set(), set()
        waiting, n = [], -1

        def judge():
            p = self._softmax(self._logits(self._sparse([f for _, _, f in waiting])))
            best = np.argmax(p[:, :-1], axis=1)
            for i in np.flatnonzero(p[np.arange(len(best)), best] > self.threshold).tolist():
                paragraph, w, _ = waiting[i]
                if self._confirmed(int(best[i]), w):
                    found.add(self.families[best[i]])
                    confirmed.add(paragraph)
                else:
                    doubtful.add(paragraph)
            waiting.clear()

        for n, lines in enumerate(paragraphs(text)):
            for s in sentences(lines):
                for w in windows(s):
                    f = self.features(w)
                    if f[2]:  # without a known pair: unknown
                        waiting.append((n, w, f))
                        if len(waiting) >= TOGETHER:
                            judge()
        if waiting:
            judge()
        return sorted(found), n + 1, len(doubtful - confirmed)


def train(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES,
          sample: int = SAMPLE) -> LicenceModel:
    """Fit a model: variants of the templates against paragraphs of at most about ``sample``
    texts, those with the smallest hashes, a sentence of one line of each."""
    known = docs.filter("text IS NOT NULL").select("text", F.xxhash64("doc_id").alias("h"))
    n = known.select("h").count()
    share = min(1.0, sample / n) if n else 1.0
    top = min(2**63 - 1, int(share * 2**64) - 2**63)
    parts = F.split("text", "\n")
    one = F.element_at(parts, (F.pmod(F.col("h"), F.size(parts)) + 1).cast("int"))
    rows = known.filter(F.col("h") <= F.lit(top)).select(one.alias("p"), "h").collect()
    return LicenceModel(templates, [r["p"].encode() for r in sorted(rows, key=lambda r: (r["h"], r["p"]))])


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """``(doc_id, n_paragraphs, licences, n_unconfirmed)`` for each row, from the whole text.

    A paragraph is a line with a letter or digit, and the lines that its last sentence goes
    on in. licences: sorted array of the families confirmed in any of them; n_unconfirmed:
    paragraphs taken for a licence that no template confirms. Null and empty texts have no
    paragraph. Rows are judged each by itself, repeated ones and those with a null doc_id
    too. An empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_text(batches):
            n, found, doubtful = [], [], []
            for t in texts:
                names, count, d = model.scan(t or b"")
                n.append(count)
                found.append(names)
                doubtful.append(d)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.string())),
                 pa.array(doubtful, pa.int64())], ["doc_id", "n_paragraphs", "licences", "n_unconfirmed"])

    return in_arrow(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, n_paragraphs bigint, licences array<string>, n_unconfirmed bigint")
