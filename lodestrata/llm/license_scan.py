"""Licence scan: a trained paragraph classifier with a calibrated unknown class, confirmed by template comparison.

Paragraphs are lines, and runs of lines without a wordless one between them that together hold a notice wrapped over them.
A sparse multinomial logistic regression over word 1- to 3-grams gives each paragraph a licence
family or ``unknown``. It is trained here: positives are variants of the public notices below (words dropped, numbers
changed, ordinary words around them); negatives are a bounded sample of the corpus's own paragraphs, at most
``NEGATIVES`` (those that resemble a notice are left out), and everyday sentences about licences. A temperature fitted on
held-out notices calibrates the probabilities. A prediction is confirmed if a template of the family shares at least 0.8
of its five-word shingles (numbers masked; its whole word sequence, if shorter) with the paragraph.

A paragraph without any n-gram of the vocabulary has the same probabilities as an empty one, which is unknown; so only
paragraphs with a trigger word (the rarest word of some n-gram) are scored. That loses nothing.

Cases: a null text has no paragraphs; blank lines don't count; very long lines are scored whole; repeated rows return a
row each; equal probabilities go to the family earlier in name order; without documents the notices alone train the
model; an empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import byte_column, pieces, ship

#: Public notices of licence families.
TEMPLATES = {
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL v3.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC": (
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the LGPL v2.1.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": (
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without prior written permission of the publisher.",
        "This document is proprietary and confidential. Unauthorized copying is prohibited.",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights (CC0 1.0 Universal).",
        "This work is in the public domain.",
    ),
}
#: Names of each family's licences, and SPDX identifiers; with FORMS they make further notices.
NAMES = {
    "AGPL": ("GNU Affero General Public License", "GNU AGPL", "AGPL-3.0"),
    "Apache": ("Apache License", "Apache License 2.0", "Apache Software License"),
    "BSD": ("BSD License", "3-Clause BSD License", "New BSD License"),
    "CC": ("Creative Commons Attribution License", "CC BY-ND 4.0", "Creative Commons licence"),
    "GPL": ("GNU General Public License", "GNU GPL", "GPL v3"),
    "ISC": ("ISC License", "ISC licence"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "LGPL v3"),
    "MIT": ("MIT License", "MIT licence", "Expat License"),
    "MPL": ("Mozilla Public License", "MPL 2.0", "Mozilla Public License 2.0"),
    "Proprietary": ("proprietary license agreement", "commercial license agreement"),
    "Public-Domain": ("Unlicense", "CC0 public domain dedication"),
}
IDENTIFIERS = {
    "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "CC": ("CC-BY-4.0", "CC-BY-SA-4.0"),
    "GPL": ("GPL-2.0-only", "GPL-3.0-only"),
    "ISC": ("ISC",),
    "LGPL": ("LGPL-2.1-only", "LGPL-3.0-or-later"),
    "Proprietary": ("LicenseRef-Proprietary",),
    "Public-Domain": ("Unlicense", "CC0-1.0"),
}
FORMS = ("Licensed under the {}.", "Released under the terms of the {}.", "This project is distributed under the {}.", "This file is covered by the {}, see the LICENSE file for details.")
NOTICES = {f: (*texts, *(form.format(name) for name in NAMES[f] for form in FORMS), *(f"SPDX-License-Identifier: {x}" for x in IDENTIFIERS.get(f, ()))) for f, texts in TEMPLATES.items()}
#: Sentences that mention licences without granting one.
EVERYDAY = (
    "You need a driving license to rent a car in this city.",
    "The committee discussed whether the license fee should rise next year.",
    "She renewed her fishing license at the public office.",
    "The software was released under pressure and the version had many errors.",
    "General rights and public duties were reserved for the next chapter.",
    "The conditions of the agreement are discussed in the following section.",
    "Free copies of the work were distributed at the conference.",
    "He was granted permission to use the library.",
)
UNKNOWN = "unknown"
CLASSES = (*sorted(TEMPLATES), UNKNOWN)
MIN_P, CONFIRM, SHINGLE = 0.5, 0.8, 5
#: What the fit takes: at most NEGATIVES of the corpus's lines, from the first SAMPLE_LINES lines of half as many documents, the
#: first in the order of a hash among those of under SAMPLE_BYTES; VARIANTS of each notice. Every HELD-th notice of a family, and
#: every HELD-th variant of the others, are held out of the first fit, which gives the temperature and the accuracies; the
#: second fit has all.
NEGATIVES, SAMPLE_LINES, SAMPLE_BYTES, VARIANTS, HELD = 2000, 3, 20_000, 12, 5
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def grams(words: list[bytes]) -> set[bytes]:
    out = set(words)
    out.update(a + b" " + b for a, b in zip(words, words[1:]))
    out.update(a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:]))
    return out


def _shingled(words: list[bytes]) -> frozenset[tuple[bytes, ...]]:
    masked = [b"0" if w.isdigit() else w for w in words]
    return frozenset(tuple(masked[i : i + SHINGLE]) for i in range(max(1, len(masked) - SHINGLE + 1))) if masked else frozenset()


#: Of each template: family, words and shingles, and the distinct words that aren't numbers.
_WHOLE = [(f, w := words_of(t.encode()), _shingled(w), frozenset(x for x in w if not x.isdigit())) for f, texts in sorted(NOTICES.items()) for t in texts]
#: The fewest of n shingles that confirm.
_LEAST = {n: min(m for m in range(1, n + 1) if m / n >= CONFIRM) for n in {len(x[2]) for x in _WHOLE}}
_SHAPES = {family: [(len(words_of(t.encode())), _shingled(words_of(t.encode()))) for t in texts] for family, texts in NOTICES.items()}


def containment(family: str, words: list[bytes]) -> float:
    """The largest share of a template's shingles that the paragraph has."""
    whole = _shingled(words)
    best = 0.0
    for n, shape in _SHAPES[family]:
        if n < SHINGLE:
            masked = [b"0" if w.isdigit() else w for w in words]
            target = next(iter(shape))
            best = max(best, float(any(tuple(masked[i : i + n]) == target for i in range(len(masked) - n + 1))))
        else:
            best = max(best, len(whole & shape) / len(shape))
    return best


def _share(template: tuple, words: list[bytes]) -> float:
    """The share of a template's shingles that the words have."""
    _, own, shape, _ = template
    if len(own) >= SHINGLE:
        return len(_shingled(words) & shape) / len(shape)
    masked, target = [b"0" if w.isdigit() else w for w in words], next(iter(shape))
    return float(any(tuple(masked[i : i + len(own)]) == target for i in range(len(masked) - len(own) + 1)))


def _needed(template: tuple) -> int:
    """How many of its distinct words a text must have to hold CONFIRM of a template's shingles: every missing word lacks a
    shingle, the last one up to SHINGLE words."""
    _, _, shape, distinct = template
    lost = len(shape) - _LEAST[len(shape)]
    return len(distinct) - (lost + SHINGLE - 1 if lost else 0)


_NEEDED = [(_needed(t), t) for t in _WHOLE]
_KNOWN = frozenset().union(*(t[3] for t in _WHOLE))


def wrapped(lines: list[list[bytes]]) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of two or more lines that hold CONFIRM of a template's shingles."""
    known = _KNOWN.intersection(*[set().union(*lines)])
    out = set()
    masked = [b"0" if w.isdigit() else w for line in lines for w in line]
    held: dict[int, set[tuple[bytes, ...]]] = {}  # the block's strings of n words, for templates of that many and for shingles
    for needed, template in _NEEDED:
        if needed > len(known) or len(known & template[3]) < needed:
            continue
        _, own, shape, _ = template
        n = min(len(own), SHINGLE)
        if n not in held:
            held[n] = set(zip(*(masked[i:] for i in range(n))))
        if len(held[n] & shape) < _LEAST[len(shape)]:
            continue
        start = 0
        while start < len(lines):
            holds = lambda a, b: _share(template, [w for line in lines[a:b] for w in line]) >= CONFIRM
            if not holds(start, len(lines)):
                break
            low, high = start + 1, len(lines)  # the first end that is enough, then the last start
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if holds(start, middle) else (middle + 1, high)
            end, first, last = low, start, low - 1
            while first < last:
                middle = (first + last + 1) // 2
                first, last = (middle, last) if holds(middle, end) else (first, middle - 1)
            if end - first > 1:
                out.add((first, end - 1))
            start = first + 1
    return sorted(out)


class Model:
    """Vocabulary, weights per n-gram and class, and the temperature."""

    def __init__(self, negatives: list[bytes], seed: int = 7) -> None:
        rng = random.Random(seed)
        plain = [w for n in negatives if (w := words_of(n)) and max(containment(f, w) for f in TEMPLATES) < 0.5]
        filler = [w for n in plain[:400] for w in n[:40]] or [b"text"]
        other = len(CLASSES) - 1
        rows: list[tuple[list[bytes], int, int]] = [(w, other, int(i % HELD == 0)) for i, w in enumerate(plain)]
        for family, texts in sorted(NOTICES.items()):
            for at, text in enumerate(texts):
                words = words_of(text.encode())
                for variant in range(VARIANTS):
                    w = [str(rng.randint(1, 4)).encode() if x.isdigit() and rng.random() < 0.3 else x for x in words]
                    if variant and len(w) > 6:
                        w = [x for x in w if rng.random() > 0.08]
                    if variant % 3 == 1:
                        w = rng.choices(filler, k=rng.randint(1, 30)) + w
                    if variant % 3 == 2:
                        w = w + rng.choices(filler, k=rng.randint(1, 30))
                    rows.append((w, CLASSES.index(family), 2 if at % HELD == HELD - 1 else int(variant % HELD == HELD - 1)))
        rows += [(words_of(t.encode()), other, 0) for t in EVERYDAY for _ in range(8)]
        # everyday sentences with filler in their midst teach that single licence words prove nothing
        rows += [(rng.choices(filler, k=rng.randint(5, 40)), other, int(i % HELD == 0)) for i in range(200)]
        held, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
        self._learn([r[0] for r in rows], y, held == 0)
        logits = self._design([r[0] for r in rows if r[2]]) @ self.weights + self.bias
        truth, held = y[held > 0], held[held > 0]
        loss = lambda t: -np.log(np.maximum(self._softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        self.temperature = float(min(np.linspace(0.2, 3, 57), key=loss))
        right = logits.argmax(1) == truth
        #: Of notices not seen in the first fit; of held-out variants of seen ones and other lines.
        self.unseen, self.accuracy = float(right[held == 2].mean()), float(right[held == 1].mean())
        self._learn([r[0] for r in rows], y, np.ones(len(rows), bool))

    def _learn(self, rows: list[list[bytes]], y: np.ndarray, used: np.ndarray) -> None:
        """Vocabulary, triggers and weights from the used rows."""
        kept = [(w, label) for w, label, u in zip(rows, y, used) if u]
        counts = Counter(g for w, label in kept if label < len(CLASSES) - 1 for g in grams(w))
        common = Counter(g for w, label in kept if label == len(CLASSES) - 1 for g in grams(w))
        self.vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= 6 and common[g] * 4 <= n))}
        self.triggers = {min(g.split(b" "), key=lambda w: (common[w], w)) for g in self.vocabulary}
        self.weights, self.bias, self.temperature = np.zeros((len(self.vocabulary), len(CLASSES)), np.float32), np.zeros(len(CLASSES)), getattr(self, "temperature", 1.0)
        self._fit(self._design([w for w, _ in kept]), np.array([label for _, label in kept]))

    def _design(self, rows: list[list[bytes]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.vocabulary)), np.float32)
        for i, words in enumerate(rows):
            at = [self.vocabulary[g] for g in grams(words) if g in self.vocabulary]
            x[i, at] = 1
        return x

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> None:
        target = np.eye(len(CLASSES), dtype=np.float32)[y]
        m, v, mb, vb = np.zeros_like(self.weights), np.zeros_like(self.weights), 0.0, 0.0
        for step in range(1, rounds + 1):
            error = (self._softmax(x @ self.weights + self.bias) - target).astype(np.float32) / len(y)
            g, gb = x.T @ error + l2 * self.weights, error.sum(0)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            a, b = 1 - 0.9**step, 1 - 0.99**step
            self.weights = (self.weights - 0.05 * (m / a) / (np.sqrt(v / b) + 1e-8)).astype(np.float32)
            self.bias = self.bias - 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-8)

    def predict(self, words: list[bytes]) -> tuple[str, float]:
        at = sorted(self.vocabulary[g] for g in grams(words) if g in self.vocabulary)
        p = self._softmax(((self.weights[at].sum(0) + self.bias) / self.temperature)[None, :])[0]
        best = int(p.argmax())
        return CLASSES[best], float(p[best])

    def paragraphs(self, text: bytes) -> tuple[int, list[tuple[int, str, float, bool]]]:
        """How many paragraphs there are, and (line, family, probability, confirmed) of those with a licence."""
        count, found = 0, []
        block: list[list[bytes]] = []
        for number, line in enumerate(text.split(b"\n")):
            words = line.translate(_TABLE).split()
            count += bool(words) or bool(line.strip())
            if not words:
                found += self._runs(block, number)
                block = []
                continue
            block.append(words)
            if self.triggers.isdisjoint(words):
                continue
            family, p = self.predict(words)
            if family != UNKNOWN and p >= MIN_P:
                found.append((number, number, family, p, containment(family, words) >= CONFIRM))
        found += self._runs(block, number + 1)
        runs = [f[:2] for f in found if f[0] < f[1]]
        # the lines of a wrapped notice are its fragments unless they are confirmed on their own
        kept = [f for f in found if f[0] < f[1] or f[4] or not any(a <= f[0] <= b for a, b in runs)]
        return count, [(f[0], *f[2:]) for f in sorted(kept)]

    def _runs(self, block: list[list[bytes]], end: int) -> list[tuple[int, int, str, float, bool]]:
        """(first line, last line, family, probability, confirmed) of the notices wrapped over lines of a block."""
        out = []
        if len(block) < 2 or all(map(self.triggers.isdisjoint, block)):
            return out
        for a, b in wrapped(block):
            words = [w for line in block[a : b + 1] for w in line]
            family, p = self.predict(words)
            if family != UNKNOWN and p >= MIN_P and containment(family, words) >= CONFIRM:
                out.append((end - len(block) + a, end - len(block) + b, family, p, True))
        return out


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        lines = [line for text in byte_column(batch, "text") for line in text.split(b"\n", SAMPLE_LINES)[:SAMPLE_LINES]]
        yield pa.RecordBatch.from_arrays([pa.array([line.decode("utf-8", "replace") for line in lines if line.strip()], pa.string())], names=["line"])


def train(docs: DataFrame) -> Model:
    """Fits on the notices and at most NEGATIVES paragraphs of as many documents, the first in the order of a hash."""
    ship(docs.sparkSession)
    keyed = docs.where(F.col("text").isNotNull() & (F.octet_length("text") < SAMPLE_BYTES)).select(F.xxhash64("text").alias("key"), "text")
    # hashes alone are sorted; the texts are read again for those that are chosen
    keys = [r["key"] for r in keyed.select("key").orderBy("key").limit(NEGATIVES // 2).collect()]
    chosen = keyed.where(F.col("key") <= (keys[-1] if keys else 0)).dropDuplicates(["key"]).select("text")
    lines = chosen.mapInArrow(_sample, "line string").orderBy(F.xxhash64("line"), "line").limit(NEGATIVES).collect()
    return Model([r["line"].encode() for r in lines])


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: ``doc_id, n_paragraphs, n_licensed, families`` (confirmed, in name order), ``unconfirmed``,
    ``best_family, best_probability`` and ``found`` (line, family, probability, confirmed)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))
    names = ["doc_id", "n_paragraphs", "n_licensed", "families", "unconfirmed", "best_family", "best_probability", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, "text"):
            out = [model.paragraphs(t) for t in byte_column(batch, "text")]
            top = [max(found, key=lambda f: (f[3], f[2]), default=None) for _, found in out]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([len(f) for _, f in out], pa.int64()),
                pa.array([sorted({x[1] for x in f if x[3]}) for _, f in out], pa.list_(pa.string())), pa.array([sorted({x[1] for x in f if not x[3]}) for _, f in out], pa.list_(pa.string())),
                pa.array([t[1] if t else UNKNOWN for t in top], pa.string()), pa.array([t[2] if t else None for t in top], pa.float64()),
                pa.array([[dict(zip(("line", "family", "probability", "confirmed"), x)) for x in f] for _, f in out], kind),
            ], names=names)

    schema = "doc_id long, n_paragraphs long, n_licensed long, families array<string>, unconfirmed array<string>, best_family string, best_probability double, found array<struct<line:int,family:string,probability:double,confirmed:boolean>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
