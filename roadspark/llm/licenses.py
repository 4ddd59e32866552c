"""Licence scans: a paragraph classifier over sparse word n-grams, confirmed by templates.

A multinomial logistic regression over hashed word 1- to 3-grams is trained on the notices of TEMPLATES (with words
left out and paragraphs cut, by rule) and on paragraphs that are no licence.  Its last class is `unknown`: prose about
licences that is no family's notice; the class before it is `none`.  Probabilities are calibrated by a temperature,
fitted on notices that their model had not seen: each fold's notices, in all their variants, are scored by a model
of the other folds' alone.

A paragraph is a run of lines, without an empty one between, each of which is likelier of a licence's class than of
none, with a probability of CANDIDATE or more of not being none; so a notice that is wrapped over several lines is one paragraph, and the prose around it is not
part of it.  A paragraph is of a family if licences together have a probability of CONFIDENT or more and it holds
CONTAINED or more of the word pairs of one of the family's templates, or lies within it to that degree; what the
classifier takes for a licence and no template confirms is `unknown`, if it has a pair of words of a template or of prose
about licences (UNKNOWN) at all.  A paragraph is of every family that a template
confirms, the most probable first, if it names the family: it holds a pair of words of that family's templates alone,
or, of a template without such a pair, a pair that no other family found there has.

The model is trained once, on the driver, and broadcast; its size is fixed.

Defined cases: null and empty texts have no paragraphs; a line of any length is scanned whole; repeated rows are
scanned each; a text with several notices has several families; an empty table gives no rows; other columns are
passed through only if named.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm import _bytes

BITS = 16
CANDIDATE, CONFIDENT = 0.3, 0.5
CONTAINED = 0.6
FOLDS = 2
U64 = np.uint64

#: Notices of each family as they stand in sources and on pages; digits are left out of the comparison.
TEMPLATES = {
    "Apache": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0", "Apache License", "Apache License, Version 2.0, January 2004", "Licensed under Apache 2.0", "License: Apache-2.0", "or Apache-2.0", "and Apache-2.0", "Apache Software License"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT", "MIT License", "The MIT License (MIT)", "Licensed under MIT", "License: MIT", "or MIT", "and MIT", "under the terms of the MIT license"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License", "GNU GPL v3", "Licensed under the GPL", "Licensed under the GNU GPL version 2 or later", "License: GPLv3", "GPLv2 or later", "or GPL", "and GPL", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1", "GNU Lesser General Public License", "GNU LGPL", "Licensed under the LGPL", "License: LGPLv3", "LGPLv2 or later"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0", "GNU Affero General Public License", "GNU AGPL", "Licensed under the AGPL", "License: AGPLv3"],
    "BSD": ["Released under the BSD License", "Licensed under the 3-Clause BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "SPDX-License-Identifier: BSD-3-Clause", "BSD License", "Licensed under BSD", "License: BSD", "or BSD", "and BSD", "BSD 3-Clause License", "New BSD License", "Simplified BSD License"],
    "MPL": ["Licensed under the Mozilla Public License, Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License", "Licensed under the MPL", "License: MPL 2.0"],
    "ISC": ["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "ISC License", "Licensed under ISC", "License: ISC"],
    "EPL": ["Licensed under the Eclipse Public License, version 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "Eclipse Public License", "Licensed under the EPL", "License: EPL 2.0"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "License: CC BY 4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "License: CC BY-SA 4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "License: CC BY-NC 4.0"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives 4.0", "License: CC BY-ND 4.0"],
    "CC0": ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication", "License: CC0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "Unlicense": ["Released under the Unlicense", "This is free and unencumbered software released into the public domain.", "The Unlicense", "License: Unlicense"],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced or distributed without prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
#: Prose about licences that is no notice.
UNKNOWN = ["Licensed under the terms of the agreement", "This work is licensed under the following terms", "Released under a custom license", "Licensed under the Example Community License, version 1", "Redistribution is permitted under the vendor license", "This software is provided under its own license terms", "Distributed under the terms of a licence that is described elsewhere", "Permission is granted to use this document under the house license", "Licensed under the Research Use License", "Released under the Foo Public License, version 2"]
#: Prose that is no licence.
NONE = ["The and of to in is that with for on was by as at from", "He said that the version of the work was under review", "the software was published with a new version of the file", "We released the report on the state of the library", "Permission to enter the building was granted by the guard", "Copyright law is a subject of study", "You can see the source of the river from the hill", "The general public was free to use the path", "Der die und das ist nicht mit von zu ein eine im", "de la que el en y los del las por con para una", "le de la les des et est une du en dans pour que qui", "This program was shown on television", "Public transport is free of charge for any person", "the name of the author and the title of the book", "In law, terms and conditions apply", "a copy of the letter was obtained", "distributed files and folders", "a binary star", "the lesser of the two, in general", "apache helicopters and gnu herds"]
FAMILIES = [*TEMPLATES]
CLASSES = [*FAMILIES, "none", "unknown"]


def words(text: str) -> list[bytes]:
    buf = _bytes.LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = _bytes.words(buf, np.array([0, len(buf)]), _LETTERS)
    return [buf[a:b].tobytes() for a, b in zip(start, end)]


_LETTERS = _bytes.WORD.copy()
_LETTERS[0x30:0x3A] = False  # versions don't tell families


def _features(buf: np.ndarray, offsets: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams (marked in known, if given) of each paragraph: (paragraph, feature) pairs in order, and
    each paragraph's number of n-grams, met or not."""
    buf = _bytes.LOWER[buf]
    start, end, bounds = _bytes.words(buf, offsets, _LETTERS)
    h = _bytes.hash_words(buf, start, end)
    para = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    out = []
    g = h
    for n in range(1, 4):
        if n > 1:
            g = _bytes.mix(g[:-1] * U64(0xD6E8FEB86659FD93) + h[n - 1 :])
            if not len(g):
                break
        f, p = (g >> U64(64 - BITS)).astype(np.int64), para[: len(g)]
        ok = para[n - 1 :] == p
        if known is not None:
            ok &= known[f]
        out.append(p[ok] << BITS | f[ok])
    both = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    n = np.diff(bounds)
    return both >> BITS, both & ((1 << BITS) - 1), np.maximum(1, n + np.maximum(0, n - 1) + np.maximum(0, n - 2))


def _variants(text: str, turns: range) -> list[str]:
    """A notice whole, without some words, cut short, and within other prose, by rule."""
    w = text.split()
    out = [text]
    for t in turns:
        keep = [x for i, x in enumerate(w) if (i * 7 + t * 3) % 11 or len(w) < 5]
        out.append(" ".join(keep))
        if len(w) > 12:
            out.append(" ".join(w[t % 3 : max(10, len(w) - t % 5)]))
        out.append(NONE[t % len(NONE)] + ". " + text)
    return out


def _table() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, their classes, and the fold of the notice that each is a variant of."""
    texts, y, fold, turns = [], [], [], range(0, 6)
    whole = {t for v in TEMPLATES.values() for t in v}
    for c, notices in enumerate([*TEMPLATES.values(), NONE, UNKNOWN]):
        for k, n in enumerate(notices):
            # a variant that is a notice of its own is left to that one's fold
            v = [n, *(x for x in _variants(n, turns)[1:] if x not in whole)] if c < len(FAMILIES) else [n, n.lower(), *(" ".join(n.split()[t % 3 :]) for t in turns)]
            texts += v
            y += [c] * len(v)
            fold += [k % FOLDS] * len(v)
    return texts, np.array(y), np.array(fold)


Model = tuple[np.ndarray, np.ndarray, np.ndarray, float]


@lru_cache(maxsize=1)
def model() -> Model:
    """Marks of the features met, weights (feature, class), biases, temperature."""
    texts, y, fold = _table()
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    p, f, n = _features(np.concatenate(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), None)
    used, col = np.unique(f, return_inverse=True)
    x = np.zeros((len(texts), len(used)))
    x[p, col] = 1
    x /= np.sqrt(n)[:, None]

    def fitted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        target = np.eye(len(CLASSES))[y]
        share = 1 / np.maximum(1, np.bincount(y, minlength=len(CLASSES)))[y]
        w, b = np.zeros((x.shape[1], len(CLASSES))), np.zeros(len(CLASSES))
        b[CLASSES.index("none")] = 1.0
        for _ in range(400):
            z = x @ w + b
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            g = (q - target) * share[:, None]
            w -= 2.0 * (x.T @ g + 2e-4 * w)
            b -= 0.2 * g.sum(0)
        return w, b

    # calibration on notices that their model has not seen
    z = np.zeros((len(texts), len(CLASSES)))
    for k in range(FOLDS):
        w, b = fitted(x[fold != k], y[fold != k])
        z[fold == k] = x[fold == k] @ w + b

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y]).mean())

    temperature = min(np.geomspace(0.2, 5, 60), key=loss)
    w, b = fitted(x, y)
    known = np.zeros(1 << BITS, bool)
    known[used] = True
    full = np.zeros((1 << BITS, len(CLASSES)), np.float32)
    full[used] = w
    return known, full, b.astype(np.float32), float(temperature)


@lru_cache(maxsize=1)
def pairs() -> dict[str, list[set]]:
    def of(t: str) -> set:
        w = words(t)
        return set(zip(w, w[1:])) or {(x, b"") for x in w}

    return {k: [of(t) for t in v] for k, v in TEMPLATES.items()}


@lru_cache(maxsize=1)
def legal_pairs() -> set:
    """The word pairs of all templates and of prose about licences, but for those of other prose."""
    of = lambda texts: {p for w in map(words, texts) for p in zip(w, w[1:])}
    return of([*(t for v in TEMPLATES.values() for t in v), *UNKNOWN]) - of(NONE)


def confirmed(paragraph: str, family: str) -> bool:
    w = words(paragraph)
    own = set(zip(w, w[1:]))
    # each template's pairs must be in the paragraph, or a long paragraph's in the template
    return any(len(own & t) >= CONTAINED * min(len(t), max(len(own), 6)) for t in pairs()[family])


@lru_cache(maxsize=1)
def own_pairs() -> dict[str, set]:
    """The word pairs that tell a family: in its templates alone, and in several of them, or with a word that no other
    family's templates have."""
    sets = {k: set().union(*v) for k, v in pairs().items()}
    vocabulary = {k: {x for t in TEMPLATES[k] for x in words(t)} for k in TEMPLATES}
    out = {}
    for k, own in sets.items():
        others = set().union(*(o for f, o in sets.items() if f != k))
        foreign = set().union(*(v for f, v in vocabulary.items() if f != k), *(words(t) for t in [*UNKNOWN, *NONE]))
        out[k] = {p for p in own - others if sum(p in t for t in pairs()[k]) > 1 or p[0] not in foreign or p[1] and p[1] not in foreign}
    return out


def named(paragraph: str, family: str, others: list[str]) -> bool:
    """Whether a paragraph of the other families names this one too."""
    w = words(paragraph)
    own = set(zip(w, w[1:]))
    alone = own_pairs()[family]
    theirs = set().union(*(t for f in others for t in pairs()[f]))
    return bool(own & alone) or any(not t & alone and len(own & t) >= CONTAINED * len(t) and not own & t <= theirs for t in pairs()[family])


def _probabilities(buf: np.ndarray, cut: np.ndarray, of: Model) -> np.ndarray:
    """Of the spans that cut makes, each class's probability."""
    known, weights, bias, temperature = of
    p, f, n = _features(buf, cut, known)
    z = np.tile(bias, (len(cut) - 1, 1))
    z[:, CLASSES.index("none")] += 50 * (np.bincount(p, minlength=len(z)) == 0)  # not a word of a licence
    if len(p):
        para, first = np.unique(p, return_index=True)
        z[para] += np.add.reduceat(weights[f], first, axis=0) / np.sqrt(n[para])[:, None]
    z = z / temperature
    q = np.exp(z - z.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def scan_texts(column: pa.Array, of: Model | None = None) -> list[list[tuple[str, float]]]:
    """(family, probability) of each licence paragraph of each text."""
    raw, offsets = _bytes.strings(column)
    of = of or model()
    out: list[list[tuple[str, float]]] = [[] for _ in range(len(offsets) - 1)]
    none = CLASSES.index("none")
    for i, j in _bytes.pieces(offsets):
        buf = raw[offsets[i] : offsets[j]]
        off = offsets[i : j + 1] - offsets[i]
        cut = np.unique(np.concatenate((off, np.flatnonzero(buf == 10) + 1)))
        if len(cut) < 2:
            continue
        q = _probabilities(buf, cut, of)
        line = np.flatnonzero((q.argmax(1) != none) & (1 - q[:, none] >= CANDIDATE))
        if not len(line):
            continue
        # lines behind one another, in one text, are a paragraph; an empty line is a line of its own, and no candidate
        doc = np.searchsorted(off, cut[line], side="right") - 1
        first = np.flatnonzero(np.concatenate(([True], (np.diff(line) > 1) | (np.diff(doc) > 0))))
        last = np.append(first[1:], len(line)) - 1
        spans = [buf[cut[line[a]] : cut[line[b] + 1]] for a, b in zip(first, last)]
        q = _probabilities(np.concatenate(spans), np.concatenate(([0], np.cumsum([len(s) for s in spans]))), of)
        for k in np.flatnonzero((q.argmax(1) != none) & (1 - q[:, none] >= CONFIDENT)):
            text = spans[k].tobytes().decode("utf-8", "replace")
            families = q[k, : len(FAMILIES)]
            # the families in the order of their probability; a template has the last word
            found: list[str] = []
            for c in np.argsort(-families):
                if confirmed(text, FAMILIES[c]) and named(text, FAMILIES[c], found):
                    found.append(FAMILIES[c])
            at = i + int(doc[first[k]])
            if found and families.sum() >= CONFIDENT:
                out[at] += [(f, float(families[FAMILIES.index(f)])) for f in found]
            elif not legal_pairs().isdisjoint(zip(words(text), words(text)[1:])):
                out[at].append(("unknown", float(q[k, -1])))
    return out


def scan(docs: DataFrame, *, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns of docs, notices (family and probability of each licence paragraph, in order) and licences (the
    distinct families, sorted, comma-joined)."""
    from pyspark.sql.types import StructField, StructType

    sent = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64())]))
        for batch in batches:
            found = scan_texts(batch.column(0), sent.value)
            notices = pa.array([[{"family": f, "probability": p} for f, p in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], notices, pa.array([",".join(sorted({f for f, _ in x})) for x in found], pa.string())], names=[*(f"c{i}" for i in range(len(columns))), "notices", "licences"])

    own = docs.select(F.col("text").alias("_text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    extra = StructType.fromDDL("notices array<struct<family: string, probability: double>>, licences string")
    schema = StructType([*(StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)), *extra.fields])
    return own.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "notices", "licences")
