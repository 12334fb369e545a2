"""Licence scans with a trained paragraph classifier.

A paragraph (a line; long ones in overlapping windows of words; and what a notice wrapped over several lines of a block
without blank lines has in common with a template, comment marks aside) is the sparse set of those of its word 1- to 3-grams
that occur in a template. A multinomial logistic regression with an L1 penalty tells licence families and an unknown class
apart. It is trained on variants of the templates below, and for the unknown class on a bounded sample of the corpus's own
paragraphs and on scrambled pieces of several templates. A temperature fitted on variants kept out of the training
calibrates the probabilities. Every paragraph is classified; a family of at least ``least`` is confirmed by comparing word
pairs: the paragraph must have the larger part of those of one of the family's templates, which are whole notices and
the short forms that stand for them. What is not confirmed stays unknown.

Null and empty texts have no paragraphs. Very long texts are read line by line and window by window. Repeated rows keep a
row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: The usual notices of each licence family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License v3.0.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "all-rights-reserved": ["All rights reserved.", "Copyright (c) 2020 Example Company. All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."],
    "apache": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "This article is distributed under the terms of the Creative Commons Attribution License (CC BY), which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.", "This work is in the public domain."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program.", "Licensed under the GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
#: The short forms that stand for a licence.
SHORT: dict[str, list[str]] = {
    "agpl": ["AGPLv3", "GNU AGPL", "AGPL 3.0"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache 2.0"],
    "bsd": ["BSD License", "BSD 2-Clause", "BSD 3-Clause License"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC", "Creative Commons Attribution-NonCommercial"],
    "cc-by-sa": ["CC BY-SA", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike"],
    "cc0": ["CC0 1.0", "CC0 license"],
    "gpl": ["GPLv2", "GPLv3", "GNU GPL", "GPL v2", "GPLv2 or later", "GNU GPL version 2", "GNU General Public License"],
    "isc": ["ISC License"],
    "lgpl": ["LGPLv2.1", "LGPLv3", "GNU LGPL", "GNU Lesser General Public License"],
    "mit": ["MIT License", "MIT licensed"],
    "mpl": ["MPL 2.0", "MPLv2", "Mozilla Public License"],
}
#: What stands around a short form.
BEFORE = ("", "released under", "released under the", "licensed under", "licensed under the", "distributed under the terms of the", "available under the", "this project is", "this work is licensed under a", "the code is", "license", "SPDX-License-Identifier:", "see license for the terms of the", "published under")
BEHIND = ("", "", "license", "or later", "or any later version", "see license for details", "version 2", "version 3", "for details", "4.0 international license")
WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: Words of a window and of the step to the next one.
WINDOW, STEP = 64, 32
REMEMBERED = 50_000
REMARK = re.compile(r"^\s*(?:rem|dnl)\s", re.I)


def tokens(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def paragraphs(text: str) -> Iterator[tuple[int, list[str]]]:
    """(line number, words) of each window of each line that has words."""
    for i, line in enumerate(text.split("\n")):
        found = tokens(line)
        for at in range(0, max(1, len(found) - (WINDOW - STEP)), STEP) if found else ():
            yield i, found[at : at + WINDOW]


def blocks(text: str) -> Iterator[tuple[list[int], list[str]]]:
    """(line number of each word, words) of each run of two or more lines with words.

    Comment marks are no words, but for those of batch and macro files.
    """
    lines: list[int] = []
    found: list[str] = []
    for i, line in enumerate([*text.split("\n"), ""]):
        own = tokens(REMARK.sub("", line))
        if own:
            lines += [i] * len(own)
            found += own
        elif found:
            if lines[0] != lines[-1]:
                yield lines, found
            lines, found = [], []


def wrapped(lines: list[int], found: list[str], template: set[tuple[str, str]], overlap: float) -> Iterator[tuple[int, int]]:
    """Spans of the words of a block, beyond one line, that have so large a share of the template's pairs."""
    both = list(zip(found, found[1:]))
    at = [i for i, x in enumerate(both) if x in template]
    done = 0
    for k, i in enumerate(at):
        if i < done:
            continue
        seen, stop = set(), i
        for j in at[k:]:
            if j - i > 2 * WINDOW:
                break
            if both[j] not in seen:
                seen.add(both[j])
                stop = j + 2
        if len(seen) >= overlap * len(template) and lines[i] != lines[stop - 1]:
            yield i, stop
            done = i + max(1, (stop - i) // 4)


def pairs(found: list[str]) -> set[tuple[str, str]]:
    """Word pairs, and each word beside nothing, as the templates of one word have it."""
    return {*zip(found, found[1:]), *(("", w) for w in found)}


@dataclass
class Model:
    families: list[str]  # the first is the unknown class
    words: dict[str, int]  # rows of the weights by word, by pair and by triple
    two: dict[int, int]
    three: dict[int, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    overlap: float
    templates: dict[str, list[set[tuple[str, str]]]]
    pairs: frozenset[tuple[str, str]]  # of all templates
    known: dict[frozenset[int], np.ndarray] = field(default_factory=dict, repr=False, compare=False)

    def reached(self, own: set[tuple[str, str]]) -> list[set[tuple[str, str]]]:
        """The templates of which ``own`` has the share of word pairs that confirms a family."""
        if own.isdisjoint(self.pairs):
            return []
        own = own & self.pairs
        return [t for ts in self.templates.values() for t in ts if len(t & own) >= self.overlap * len(t)]

    def features(self, found: list[str]) -> frozenset[int]:
        """Rows of the n-grams that the paragraph has. A word's row is its number; longer ones are filed by their words' numbers."""
        number, pair, triple = self.words.get, self.two.get, self.three.get
        own: set[int] = set()
        last = before = -1  # the known words right before, if they are
        for w in found:
            i = number(w, -1)
            if i >= 0:
                own.add(i)
                if last >= 0:
                    if (j := pair(last << 20 | i)) is not None:
                        own.add(j)
                    if before >= 0 and (j := triple(before << 40 | last << 20 | i)) is not None:
                        own.add(j)
                before = last
            else:
                before = -1
            last = i
        return frozenset(own)

    def vector(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = self.features(found)
        return np.fromiter(own, np.int64, len(own)), np.full(len(own), 1 / max(1.0, len(own) ** 0.5))

    def probabilities(self, found: list[str]) -> np.ndarray:
        own = self.features(found)
        p = self.known.get(own)
        if p is None:
            at = np.fromiter(own, np.int64, len(own))
            z = (self.weights[at].sum(axis=0) / max(1.0, len(own) ** 0.5) + self.bias) / self.temperature
            e = np.exp(z - z.max())
            p = e / e.sum()
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[own] = p
        return p

    def likeness(self, family: str, found: list[str]) -> float:
        """The largest share of a template's word pairs that the paragraph has."""
        own = pairs(found)
        return max((len(t & own) / len(t) for t in self.templates[family]), default=0.0)

    def classify(self, found: list[str]) -> tuple[str, float, float]:
        """The confirmed family or the unknown class, the probability of the likeliest family and that of the unknown class."""
        p = self.probabilities(found)
        k = 1 + int(p[1:].argmax())
        sure = p[k] >= self.least and self.likeness(self.families[k], found) >= self.overlap
        return self.families[k] if sure else UNKNOWN, float(p[k]), float(p[0])


def _inner(found: list[str]) -> set[tuple[str, str]]:
    return set(zip(found, found[1:])) or {("", w) for w in found}


def _variants(rng: np.random.Generator, found: list[str], others: list[list[str]], n: int) -> Iterator[list[str]]:
    """A template with words lost, and with words of the corpus around it."""
    yield found
    for _ in range(n):
        own = [w for w in found if rng.random() > 0.06]
        if others and rng.random() < 0.6:
            a, b = (others[rng.integers(len(others))] for _ in range(2))
            own = a[: rng.integers(0, 12)] + own + b[: rng.integers(0, 12)]
        if own:
            yield own


def fit(background: list[str], held_out: frozenset[str] = frozenset(), variants: int = 40, epochs: int = 6, rate: float = 0.5, l1: float = 2e-5, least: float = 0.6, overlap: float = 0.6, seed: int = 3) -> Model:
    """A model from the templates and paragraphs of the corpus; those that look like a template are left out.

    Templates that are ``held_out`` are not learnt from, but confirm.
    """
    rng = np.random.default_rng(seed)
    known = {f: [_inner(tokens(t)) for t in [*ts, *SHORT.get(f, ())]] for f, ts in TEMPLATES.items()}
    spelt = {f: [tokens(t) for t in [*ts, *SHORT.get(f, ())] if t not in held_out] for f, ts in TEMPLATES.items()}
    every = [t for ts in spelt.values() for t in ts]
    others = [w for line in background for _, w in paragraphs(line)]
    others = [w for w in others if max(len(t & pairs(w)) / len(t) for ts in known.values() for t in ts) < 0.3]
    families = [UNKNOWN, *sorted(spelt)]
    rows = [(0, w) for w in others]
    notices = [t for t in every if len(t) > 7]
    for _ in range(variants * 10):  # pieces of notices that say nothing
        cut = []
        for _ in range(rng.integers(1, 4)):
            t = notices[rng.integers(len(notices))]
            cut += [t[i] for i in rng.permutation(len(t))[: rng.integers(1, 8)]]
        rows.append((0, cut))
    for k, f in enumerate(families[1:], 1):
        rows += [(k, v) for t in spelt[f] for v in _variants(rng, t, others, variants)]
        rows += [(k, tokens(BEFORE[rng.integers(len(BEFORE))]) + t + tokens(BEHIND[rng.integers(len(BEHIND))])) for t in spelt[f] if len(t) < 8 for _ in range(variants)]
    order = rng.permutation(len(rows))
    held, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    words = {w: i for i, w in enumerate(sorted({w for t in every for w in t}))}
    longer: list[dict[int, int]] = [{}, {}]
    for n, filed in enumerate(longer, 2):
        for t in every:
            for i in range(len(t) - n + 1):
                key = 0
                for w in t[i : i + n]:
                    key = key << 20 | words[w]
                filed.setdefault(key, len(words) + len(longer[0]) * (n > 2) + len(filed))
    size = len(words) + sum(map(len, longer))
    model = Model(families, words, *longer, np.zeros((size, len(families))), np.zeros(len(families)), 1.0, least, overlap, known, frozenset().union(*(t for ts in known.values() for t in ts)))
    w, square, bias_square = model.weights, np.full((size, len(families)), 1e-3), np.full(len(families), 1e-3)
    vectors = {i: model.vector(rows[i][1]) for i in train}
    for _ in range(epochs):
        for i in rng.permutation(train):
            at, v = vectors[i]
            z = v @ w[at] + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[rows[i][0]] -= 1
            g = v[:, None] * p
            square[at] += g * g
            step = rate / np.sqrt(square[at])
            moved = w[at] - step * g
            w[at] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            bias_square += p * p
            model.bias -= rate / np.sqrt(bias_square) * p
    y = np.array([rows[i][0] for i in held])
    logits = np.stack([v @ w[at] + model.bias for at, v in (model.vector(rows[i][1]) for i in held)])
    miss = 1 / (len(held) + 2)

    def loss(t: float) -> float:
        z = logits / t
        logp = z - z.max(1, keepdims=True)
        logp = logp - np.log(np.exp(logp).sum(1, keepdims=True))
        own = logp[np.arange(len(held)), y]
        return float(-((1 - miss) * own + miss * (logp.sum(1) - own) / (len(families) - 1)).mean())

    model.temperature = float(min(np.exp(np.linspace(-3, 3, 121)), key=loss))
    return model


def train(docs: DataFrame, most: int = 600, text_col: str = "text", **options) -> Model:
    """A model whose unknown class is learnt from a paragraph of each of about ``most`` documents, at most four times as many.

    Documents are chosen by a hash of their text, the paragraph by a hash as well.
    """
    few = docs.select(F.col(text_col).cast("string").alias("text"))
    rows = few.count()
    chosen = few.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 20)) < min(1 << 20, -(-(most << 20) // max(1, rows))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0):
                lines = [w for _, w in paragraphs(t.as_py() or "")]
                if lines:
                    out.append(" ".join(min(lines, key=lambda w: hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=8).digest())))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])

    found = chosen.mapInArrow(run, "line string").distinct().orderBy(F.xxhash64("line"), "line").limit(4 * most)
    return fit(sorted(r["line"] for r in found.collect()), **options)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_paragraphs, n_licence, families, score, unknown, matches) for every row.

    n_paragraphs counts lines with words, n_licence lines with a confirmed family or a part of a wrapped notice of one;
    families are sorted by name; score is the largest probability of a confirmed one (0 without) and unknown the least
    probability of the unknown class in any paragraph (1 without paragraphs). matches has (line, last_line, family, score)
    of what was confirmed, lines counted from 0.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("line", pa.int32()), ("last_line", pa.int32()), ("family", pa.string()), ("score", pa.float64())]))

    def read(own: Model, text: str) -> tuple:
        seen, hits, matches, unknown = set(), set(), {}, 1.0
        for i, found in paragraphs(text):
            seen.add(i)
            family, p, none = own.classify(found)
            unknown = min(unknown, none)
            if family != UNKNOWN:
                hits.add(i)
                matches[i, i, family] = max(p, matches.get((i, i, family), 0.0))
        for at, found in blocks(text):
            for template in own.reached(set(zip(found, found[1:]))):
                for first, stop in wrapped(at, found, template, own.overlap):
                    family, p, none = own.classify(found[first:stop])
                    unknown = min(unknown, none)
                    if family != UNKNOWN:
                        hits.update(at[first:stop])
                        key = (at[first], at[stop - 1], family)
                        matches[key] = max(p, matches.get(key, 0.0))
        listed = [{"line": a, "last_line": b, "family": f, "score": p} for (a, b, f), p in sorted(matches.items())]
        return len(seen), len(hits), ",".join(sorted({f for _, _, f in matches})), max(matches.values(), default=0.0), unknown, listed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for b in batches:
            columns = list(zip(*(read(own, t.as_py() or "") for t in b.column(1)))) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), kind)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["id", "n_paragraphs", "n_licence", "families", "score", "unknown", "matches"])

    few = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id bigint, n_paragraphs bigint, n_licence bigint, families string, score double, unknown double, matches array<struct<line:int,last_line:int,family:string,score:double>>"
    return few.mapInArrow(run, schema).withColumnRenamed("id", id_col)
