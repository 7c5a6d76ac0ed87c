"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs (lines; windows of WINDOW words overlapping by half where a line is longer) are classified into licence
families or `unknown` by a multinomial logistic regression over word n-grams (one to three words) of the templates,
sparse: any other n-gram only adds to the paragraph's length. Every paragraph is classified. It is trained here, in numpy,
on altered copies of the templates (words lost, put in or replaced, ends cut off, put into prose) and, for `unknown`, on
paragraphs of at most UNKNOWN_DOCS documents, those least by a hash of the id, one text of at most MAX_CHARS characters for
each (UNKNOWN_PARAGRAPHS of them at most; FILLER_WORDS of their words are put into copies), and on shuffled template words.
These bounds are of the training, and hold before texts are collected; scanning is whole. A held-out part calibrates the
temperature and the prior of `unknown`. A predicted family is confirmed if one of its templates and the paragraph share
80% of the shingles (five words, or all of a shorter template) of either, and MIN_SHARED at least where the template has
so many: a few words of a notice confirm nothing.

A template may lie across the windows of a long line. Stretches of a long line that have 80% of a template's shingles are
therefore classified by themselves too, wherever they begin, and confirmed together with the words around them; their
findings may overlap with those of windows.

Scale: the sample is cut before it meets the texts; scanning is one map, the model a few hundred KB at any size. Defined
cases: null text is empty; a text without paragraphs has no finding; null ids are scanned but not trained on; repeated rows
get equal findings, and an id with several texts is trained on by the least; an empty table trains on templates and
shuffled words alone and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training: documents and paragraphs for `unknown`, words to alter copies with.
UNKNOWN_DOCS, MAX_CHARS, UNKNOWN_PARAGRAPHS, FILLER_WORDS = 300, 20_000, 4000, 5000
WINDOW = 48
SHINGLE, SIMILARITY, MIN_SHARED = 5, 0.8, 8
MIN_PROBABILITY = 0.5
UNKNOWN = "unknown"

#: Passages by which licences are stated, and paragraphs of their texts.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0 by the authors."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0 by the authors."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("apache", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("isc", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
]
#: Identifiers of licences in tags.
TAGS = {
    "apache": ["Apache-2.0"],
    "mit": ["MIT"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "mpl": ["MPL-2.0"],
    "epl": ["EPL-2.0"],
    "cc-by": ["CC-BY-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc0": ["CC0-1.0"],
    "unlicense": ["Unlicense"],
    "isc": ["ISC"],
    "zlib": ["Zlib"],
    "boost": ["BSL-1.0"],
}
TEMPLATES += [(family, f"SPDX-License-Identifier: {tag}") for family, tags in TAGS.items() for tag in tags]
_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def paragraphs(text: str, model: Model | None = None) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """(start, end, words, words to confirm by) of the text's paragraphs; with a model, of the notices in long lines too."""
    at = 0
    for line in text.split("\n"):
        words = words_of(line)
        if len(words) <= WINDOW:
            if words:
                yield at, at + len(line), words, words
        else:
            places = [m.span() for m in _WORD.finditer(line.lower())] if len(line.lower()) == len(line) else None
            units = [(a, min(a + WINDOW, len(words)), a, a + WINDOW) for a in range(0, len(words) - WINDOW // 2, WINDOW // 2)]
            for a, b in model.notices(words) if model else []:
                first = max(0, min(a - max(0, WINDOW - (b - a)) // 2, len(words) - WINDOW))
                units.append((a, b, first, max(b, first + WINDOW)))
            for a, b, first, past in units:
                start, end = (places[a][0], places[b - 1][1]) if places else (0, len(line))
                yield at + start, at + end, words[a:b], words[first:past]
        at += len(line) + 1


def _shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


class Model:
    """Weights of the template n-grams for each family."""

    def __init__(self):
        self.families = [UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES)]
        texts = [words_of(t) for _, t in TEMPLATES]
        self.words = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.keys = np.unique(np.concatenate([self._keys(np.array([self.words[w] for w in t]))[0] for t in texts]))
        self.weights = np.zeros((len(self.keys) + 2, len(self.families)), np.float32)
        self.temperature = 1.0
        self.templates: dict[str, list[tuple[int, set[tuple[str, ...]]]]] = {}
        for (family, _), t in zip(TEMPLATES, texts):
            self.templates.setdefault(family, []).append((min(SHINGLE, len(t)), _shingles(t)))
        self.sizes = [len(_shingles(t)) for t in texts]
        self.places: dict[tuple[str, ...], list[int]] = {}
        for i, t in enumerate(texts):
            for shingle in _shingles(t):
                self.places.setdefault(shingle, []).append(i)
        self.lengths = sorted({len(x) for x in self.places})

    def _keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, places) of the n-grams of known words."""
        n = len(self.words) + 1
        out, at = [], []
        key = np.zeros(len(ids), np.int64)
        for size in range(1, 4):
            if size > len(ids):
                break
            key = key[: len(ids) - size + 1] * n + ids[size - 1 :]
            known = np.ones(len(key), bool)
            for k in range(size):
                known &= ids[k : k + len(key)] > 0
            where = np.flatnonzero(known)
            out.append(key[where])
            at.append(where)
        return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate(at) if at else np.zeros(0, np.int64)

    def features(self, units: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, feature, value): n-gram counts over the root of the length, the share of known words and a constant."""
        sizes = np.array([len(u) for u in units], np.int64)
        get = self.words.get
        # A zero between paragraphs: no n-gram goes across.
        ids = np.array([i for u in units for i in (*(get(w, 0) for w in u), 0)], np.int64)
        keys, places = self._keys(ids)
        found = np.searchsorted(self.keys, keys)
        hit = (found < len(self.keys)) & (self.keys[np.minimum(found, len(self.keys) - 1)] == keys)
        unit = np.repeat(np.arange(len(units)), sizes + 1)[places[hit]]
        root = np.sqrt(np.maximum(1, sizes)).astype(np.float32)
        known = np.bincount(np.repeat(np.arange(len(units)), sizes + 1), ids > 0, len(units)) / np.maximum(1, sizes)
        every = np.arange(len(units))
        return (
            np.concatenate((unit, every, every)),
            np.concatenate((found[hit], np.full(len(units), len(self.keys)), np.full(len(units), len(self.keys) + 1))),
            np.concatenate((1 / root[unit], known, np.ones(len(units)))).astype(np.float32),
        )

    def logits(self, units: list[list[str]]) -> np.ndarray:
        unit, feature, value = self.features(units)
        order = np.argsort(unit, kind="stable")  # each unit has a constant, so none is without entries
        unit, feature = unit[order], feature[order]
        out = np.empty((len(units), len(self.families)), np.float32)
        begins = np.searchsorted(unit, np.arange(len(units)))
        for a in range(0, len(units), 256):
            low, high = begins[a], begins[a + 256] if a + 256 < len(units) else len(unit)
            out[a : a + 256] = np.add.reduceat(self.weights[feature[low:high]] * value[order[low:high], None], begins[a : a + 256] - low, axis=0)
        return out

    def probabilities(self, units: list[list[str]]) -> np.ndarray:
        z = self.logits(units) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def notices(self, words: list[str]) -> list[tuple[int, int]]:
        """(first, past) of the stretches with SIMILARITY of a template's shingles, no more than WINDOW words between two.

        A stretch ends where a shingle comes again; of stretches of one template that overlap, the shortest are taken.
        """
        hits: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        for n in self.lengths:
            for i in range(len(words) - n + 1):
                for t in self.places.get(tuple(words[i : i + n]), ()):
                    hits.setdefault(t, []).append((i, tuple(words[i : i + n])))
        out = set()
        for t, own in hits.items():
            runs: list[tuple[int, int]] = []
            run: dict[tuple[str, ...], int] = {}

            def close(run=run, runs=runs, t=t):
                if len(run) >= SIMILARITY * self.sizes[t]:
                    first, (shingle, last) = next(iter(run.values())), next(reversed(run.items()))
                    runs.append((first, last + len(shingle)))

            for i, shingle in own:
                if run and i - next(reversed(run.values())) > WINDOW:
                    close()
                    run.clear()
                elif shingle in run:
                    close()
                    again = run[shingle]
                    for x in [x for x, place in run.items() if place <= again]:
                        del run[x]
                run[shingle] = i
            close()
            taken = bytearray(len(words))
            for a, b in sorted(runs, key=lambda r: (r[1] - r[0], r)):
                if not any(taken[a:b]):
                    taken[a:b] = b"\1" * (b - a)
                    out.add((a, b))
        return sorted(out)

    def confirmed(self, family: str, words: list[str]) -> bool:
        own: dict[int, set[tuple[str, ...]]] = {}
        for n, template in self.templates.get(family, []):
            if n not in own:
                own[n] = _shingles(words, n)
            shared = len(own[n] & template)
            if shared >= SIMILARITY * min(len(own[n]), len(template)) and shared >= min(len(template), MIN_SHARED):
                return True
        return False

    def fit(self, units: list[list[str]], labels: np.ndarray, steps: int = 120, ridge: float = 1e-4) -> None:
        unit, feature, value = self.features(units)
        n, classes = len(units), len(self.families)
        target = np.eye(classes, dtype=np.float32)[labels]
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for t in range(1, steps + 1):
            z = np.stack([np.bincount(unit, self.weights[feature, c] * value, n) for c in range(classes)], axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - target) / n
            g = np.stack([np.bincount(feature, error[unit, c] * value, len(self.weights)) for c in range(classes)], axis=1) + ridge * self.weights
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.weights -= (0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def calibrate(self, units: list[list[str]], labels: np.ndarray) -> None:
        """Temperature and prior of `unknown` of the least loss on held-out paragraphs."""
        z = self.logits(units)

        def loss(temperature: float, prior: float) -> float:
            x = (z + prior * (np.arange(z.shape[1]) == 0)) / temperature
            x = x - x.max(axis=1, keepdims=True)
            return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), labels]).mean())

        self.temperature, prior = min(((t, b) for t in np.geomspace(0.25, 4, 17) for b in np.linspace(-2, 4, 25)), key=lambda p: loss(*p))
        self.weights[-1, 0] += prior


def _altered(words: list[str], filler: list[str], rng: np.random.Generator) -> list[str]:
    out = [w for w in words if rng.random() > 0.04]
    out = [filler[rng.integers(len(filler))] if rng.random() < 0.03 else w for w in out]
    if len(out) > 12 and rng.random() < 0.4:
        cut = rng.integers(8, len(out))
        out = out[:cut] if rng.random() < 0.5 else out[-cut:]
    if rng.random() < 0.4:
        extra = [filler[i] for i in rng.integers(len(filler), size=rng.integers(1, 8))]
        out = extra + out if rng.random() < 0.5 else out + extra
    return out or words


def train(texts: list[str | None], seed: int = 3, copies: int = 24) -> Model:
    """texts: documents whose paragraphs are mostly not licences; those that a template confirms aren't trained on."""
    model, rng = Model(), np.random.default_rng(seed)
    plain = [w for t in texts for _, _, w, _ in paragraphs(t or "")]
    plain = [w for w in plain if not any(model.confirmed(f, w) for f in model.families[1:])]
    plain = [plain[i] for i in rng.permutation(len(plain))[:UNKNOWN_PARAGRAPHS]]
    filler = list(dict.fromkeys(w for p in plain for w in p))[:FILLER_WORDS] or ["word", "text", "line", "page"]
    units, labels = [], []
    for family, text in TEMPLATES:
        words = words_of(text)
        for k in range(copies):
            units.append(words if k == 0 else _altered(words, filler, rng))
            labels.append(model.families.index(family))
    every = [w for _, t in TEMPLATES for w in words_of(t)]
    for _ in range(12 * len(TEMPLATES)):
        units.append([every[i] for i in rng.integers(len(every), size=rng.integers(1, 30))])
        labels.append(0)
    units += plain
    labels += [0] * len(plain)
    part = rng.random(len(units)) < 0.8
    y = np.array(labels)
    model.fit([u for u, p in zip(units, part) if p], y[part])
    model.calibrate([u for u, p in zip(units, part) if not p], y[~part])
    return model


def scan(text: str | None, model: Model) -> list[dict]:
    """Findings in a text, in order."""
    units = list(paragraphs(text or "", model))
    if not units:
        return []
    out = []
    for i, q in enumerate(model.probabilities([u[2] for u in units])):
        best = int(q.argmax())
        if best and q[best] >= MIN_PROBABILITY:
            start, end, _, words = units[i]
            family = model.families[best]
            out.append({"family": family, "start": start, "length": end - start, "probability": float(q[best]), "confirmed": model.confirmed(family, words)})
    return sorted(out, key=lambda f: f["start"])


FINDINGS = "findings array<struct<family: string, start: long, length: long, probability: double, confirmed: boolean>>, n_paragraphs long"


def license_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, findings (family, place, calibrated probability, whether a template confirms it), n_paragraphs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = rows.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNKNOWN_DOCS)
    sample = rows.where(F.coalesce(F.char_length("text"), F.lit(0)) <= MAX_CHARS).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toArrow()
    texts = sorted(t or "" for t in sample.column("text").to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast(train(texts))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = pa.array([scan(t, shared.value) for t in texts], kind)
            numbers = pa.array([sum(1 for line in (t or "").split("\n") if line.strip()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found, numbers], names=["doc_id", "findings", "n_paragraphs"])

    return rows.mapInArrow(run, f"doc_id {id_type}, {FINDINGS}")


def license_digest(docs: DataFrame) -> DataFrame:
    """For each document its families, confirmed and predicted ones, and counts of findings."""
    sure = F.filter("findings", lambda f: f["confirmed"])
    named = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["family"]))), ",")
    return license_findings(docs).select(
        "doc_id",
        named(sure).alias("families"),
        named(F.col("findings")).alias("predicted"),
        "n_paragraphs",
        F.size("findings").cast("long").alias("n_predicted"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.coalesce(F.round(F.array_max("findings.probability"), 6), F.lit(0.0)).alias("probability"),
    )
