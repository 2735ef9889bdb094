"""Operator 3, license scans: a paragraph classifier over word n-grams, confirmed by template comparison."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, read_documents, slices

# Notices by which works name their licence, and licences' opening sentences.
TEMPLATES = {
    "0bsd": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the BSD Zero Clause License",
        "SPDX-License-Identifier: 0BSD",
    ),
    "agpl": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program",
        "This work is licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "artistic-2.0": (
        "Licensed under the Artistic License 2.0",
        "This program is free software you can redistribute it and/or modify it under the terms of the Artistic License version 2.0",
        "SPDX-License-Identifier: Artistic-2.0",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Use of this source code is governed by a BSD style license",
        "Released under the BSD license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-nc-nd": (
        "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License",
        "Licensed under CC BY-NC-ND 4.0",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "cc-by-nc-sa": (
        "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License",
        "Licensed under CC BY-NC-SA 4.0",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License",
        "Licensed under CC BY-ND 4.0",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc0": (
        "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "This work is dedicated to the public domain under CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "eupl": (
        "Licensed under the European Union Public Licence EUPL, Version 1.2",
        "SPDX-License-Identifier: EUPL-1.2",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Released under the ISC License",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "Permission is hereby granted free of charge to any person obtaining a copy of this software",
        "Released under the MIT License",
        "This software is licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "reserved": (
        "All rights reserved",
        "Copyright All rights reserved. No part of this publication may be reproduced without permission",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
        "SPDX-License-Identifier: Unlicense",
    ),
    "zlib": (
        "This software is provided as-is without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "SPDX-License-Identifier: Zlib",
    ),
}
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Casual uses of the same words; together with corpus paragraphs they are the unknown class.
CASUAL = (
    "the general was licensed to work in public and the version he gave was free",
    "you may use the source of the river and obtain a copy of the file at the office",
    "a creative person has the permission of the foundation to use commons land",
    "driving license number and terms of use for this public work",
    "the software was distributed to any person under the same conditions",
    "copyright law and rights in software were reserved for the second version",
)
#: Paragraphs of the corpus that the unknown class takes at most, and variants of each template.
TRAINING_PARAGRAPHS, VARIANTS = 2000, 24
LEAST_COVER = 0.6
#: A wrapped notice may take so many times its template's words; so many words around it are classified with it, as in training.
SPREAD, AROUND = 2, 4
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def paragraph_words(text: str) -> list[str]:
    """Lower-case words; inner points and hyphens stay (2.0, by-nc)."""
    return _WORD.findall(text.lower())


def _mutations(rng: np.random.Generator, words: list[str], filler: list[str]) -> list[str]:
    """A template as it is met: words missing or exchanged, other words before and after."""
    kept = [w if rng.random() > 0.04 else str(rng.choice(filler)) for w in words if rng.random() > 0.04]
    before = [str(w) for w in rng.choice(filler, rng.integers(0, 5))]
    return before + (kept or words) + [str(w) for w in rng.choice(filler, rng.integers(0, 5))]


class Model:
    """Weights of n-grams for each family, the temperature that calibrates them, and the templates."""

    def __init__(self, others: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        corpus = [w for w in map(paragraph_words, others) if w]
        filler = sorted({w for words in corpus for w in words}) or ["and", "of", "the"]
        rows, truth = [], []
        for label, family in enumerate(TEMPLATES):
            for template in TEMPLATES[family]:
                words = paragraph_words(template)
                made = [words] + [_mutations(rng, words, filler) for _ in range(VARIANTS)]
                rows += made
                truth += [label] * len(made)
        unknown = len(TEMPLATES)
        self.templates = {family: [self._grams(paragraph_words(t)) for t in texts] for family, texts in TEMPLATES.items()}
        casual = [paragraph_words(c) for c in CASUAL]
        casual += [[str(w) for w in rng.permutation(words)] for words in casual for _ in range(30)]
        template_words = [w for texts in TEMPLATES.values() for t in texts for w in paragraph_words(t)]
        casual += [[str(w) for w in rng.choice(template_words, 6)] + [str(w) for w in rng.choice(filler, 6)] for _ in range(400)]
        # Only template n-grams have weights: other words say nothing about a licence.
        grams = sorted({g for texts in self.templates.values() for t in texts for g in t} | {(w,) for w in template_words})
        self.vocabulary = sorted({w for g in grams for w in g})
        self.place = place = {w: i for i, w in enumerate(self.vocabulary)}
        codes = np.array([self.code(place[g[0]], place[g[1]] if len(g) > 1 else -1) for g in grams], np.int64)
        self.codes = np.sort(codes)
        #: Each template's family, words and, a row a template, its word pairs among the codes.
        self.family_of = np.array([label for label, family in enumerate(TEMPLATES) for _ in TEMPLATES[family]])
        self.words_of = [len(paragraph_words(t)) for texts in TEMPLATES.values() for t in texts]
        self.pairs_of = np.array([np.isin(self.codes, [self.code(place[a], place[b]) for a, b in t]) for texts in self.templates.values() for t in texts])
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(others, pa.string())))
        ids, line = self.word_stream(split)
        wrapped = {k for low, high, _, _ in self.wrapped(ids, line, np.zeros(len(others), np.int64)) for k in line[low:high].tolist()}
        plain = [w for k, w in enumerate(map(paragraph_words, others)) if w and k not in wrapped]
        for words in [*(w for w in plain if self.confirm(w)[1] < LEAST_COVER), *casual]:
            rows.append(words)
            truth.append(unknown)
        design = np.zeros((len(rows), len(codes) + 1), np.float32)
        design[:, -1] = 1
        for i, words in enumerate(rows):
            ids = np.array([place.get(w, -1) for w in words], np.int64)
            design[i, self.found(ids, np.zeros(len(ids), np.int64))[1]] = 1
        self.weights, self.temperature = self._fit(design, np.array(truth), rng)

    @staticmethod
    def _grams(words: list[str]) -> set[tuple[str, ...]]:
        return set(zip(words, words[1:], strict=False))

    @staticmethod
    def code(first: int, second: int) -> int:
        return (first << 20) | (second + 1)

    def found(self, ids: np.ndarray, paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, place of the n-gram's weight) of the known n-grams, each once a paragraph."""
        known = np.flatnonzero(ids >= 0)
        single = ids[known] << 20
        pair = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (paragraph[:-1] == paragraph[1:])) if len(ids) > 1 else known[:0]
        codes = np.r_[single, (ids[pair] << 20) | (ids[pair + 1] + 1)]
        owner = np.r_[paragraph[known], paragraph[pair]]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        both = np.unique(owner[hit] * len(self.codes) + at[hit])
        return both // len(self.codes), both % len(self.codes)

    @staticmethod
    def _fit(design: np.ndarray, truth: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        """Softmax regression on four fifths; the temperature minimises the log loss of the rest."""
        held = rng.random(len(truth)) < 0.2
        wanted = np.eye(len(FAMILIES), dtype=np.float32)[truth]
        x, y = design[~held], wanted[~held]
        weights = ahead = np.zeros((design.shape[1], len(FAMILIES)), np.float32)
        bound = float(np.linalg.norm(x, 2) ** 2 / (2 * len(x)) + 1e-4)
        for i in range(150):
            scores = x @ ahead
            scores = np.exp(scores - scores.max(1, keepdims=True))
            scores /= scores.sum(1, keepdims=True)
            stepped = ahead - (x.T @ (scores - y) / len(x) + 1e-4 * ahead) / bound
            ahead = stepped + i / (i + 3) * (stepped - weights)
            weights = stepped
        raw = design[held] @ weights

        def loss(t: float) -> float:
            s = raw / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - (s * wanted[held]).sum(1)).mean())

        return weights, min((0.25 * 1.1**i for i in range(40)), key=loss)

    def probabilities(self, paragraphs: int, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        scores = np.stack([np.bincount(owner, self.weights[at, k], paragraphs) for k in range(len(FAMILIES))], 1) + self.weights[-1]
        scores = np.exp((scores - scores.max(1, keepdims=True)) / self.temperature)
        return scores / scores.sum(1, keepdims=True)

    def confirm(self, words: list[str], family: str | None = None) -> tuple[str, float]:
        """The family with the best-covered template, and the share of its word pairs that the paragraph holds."""
        held = self._grams(words)
        best = (UNKNOWN, 0.0)
        for name in [family] if family else TEMPLATES:
            for grams in self.templates[name]:
                cover = len(held & grams) / len(grams)
                if cover > best[1]:
                    best = (name, cover)
        return best

    def word_stream(self, split: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in the vocabulary or -1, line) of paragraph_words of lines that are split at white space."""
        coded = split.flatten().dictionary_encode()
        parts = [paragraph_words(token) for token in coded.dictionary.to_pylist()]
        many = np.array([len(p) for p in parts], np.int64)
        known = np.array([self.place.get(w, -1) for p in parts for w in p], np.int64)
        token = coded.indices.to_numpy(zero_copy_only=False)
        if not len(token):
            return token.astype(np.int64), token.astype(np.int64)
        size = many[token]
        line = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        at = np.repeat((np.cumsum(many) - many)[token] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return known[at], np.repeat(line, size)

    def wrapped(self, ids: np.ndarray, line: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(first, past last word, the same with words around) of runs over several lines that cover a template.

        Adjacent lines of a text are put together up to a line without words. A run starts with a pair of
        the template and takes all its pairs within SPREAD times its words; the words around are of the run's lines.
        """
        if len(ids) < 2:
            return []
        apart = (line[1:] - line[:-1] > 1) | (text_of[line[1:]] != text_of[line[:-1]])
        block = np.r_[0, np.cumsum(apart)]
        pair = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & ~apart)
        code = (ids[pair] << 20) | (ids[pair + 1] + 1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        pair, at = pair[hit], at[hit]
        held, of = np.unique(block[pair], return_inverse=True)
        both = np.unique(of * len(self.codes) + at)
        owner, gram = both // len(self.codes), both % len(self.codes)
        out = set()
        for own, n_words in zip(self.pairs_of, self.words_of, strict=True):
            least = LEAST_COVER * own.sum()
            enough = np.bincount(owner[own[gram]], minlength=len(held)) >= least
            mine = np.flatnonzero(own[at] & enough[of])
            start, grams, group = pair[mine].tolist(), at[mine].tolist(), of[mine].tolist()
            inside: dict[int, int] = {}
            right = 0
            for left, first in enumerate(start):
                before = right
                while right < len(start) and group[right] == group[left] and start[right] + 2 - first <= SPREAD * n_words:
                    inside[grams[right]] = inside.get(grams[right], 0) + 1
                    right += 1
                last = start[right - 1] + 2
                if right > before and len(inside) >= least and line[first] != line[last - 1]:
                    low = max(first - AROUND, int(np.searchsorted(line, line[first])))
                    high = min(last + AROUND, int(np.searchsorted(line, line[last - 1], "right")))
                    out.add((first, last, low, high))
                inside[grams[left]] -= 1
                if not inside[grams[left]]:
                    del inside[grams[left]]
        return sorted(out)

    def cover(self, ids: np.ndarray, label: int) -> float:
        """The share of its word pairs that the family's best-covered template has among these words."""
        _, at = self.found(ids, np.zeros(len(ids), np.int64))
        pairs = self.pairs_of[self.family_of == label]
        return float((pairs[:, at].sum(1) / pairs.sum(1)).max())

    def confirmed_runs(self, ids: np.ndarray, line: np.ndarray, text_of: np.ndarray, least_probability: float) -> list[tuple[int, int, int, float, float]]:
        """(first, past last word, label, probability, cover) of wrapped notices; of overlapping ones the best covered."""
        runs = self.wrapped(ids, line, text_of)
        if not runs:
            return []
        owner = np.repeat(np.arange(len(runs)), [high - low for _, _, low, high in runs])
        chances = self.probabilities(len(runs), *self.found(np.concatenate([ids[low:high] for _, _, low, high in runs]), owner))
        ranked = []
        for (first, last, low, high), chance in zip(runs, chances, strict=True):
            label = int(chance.argmax())
            if label < len(TEMPLATES) and chance[label] >= least_probability and (cover := self.cover(ids[low:high], label)) >= LEAST_COVER:
                ranked.append((-cover, last - first, first, last, label, float(chance[label])))
        taken, out = np.zeros(len(ids), bool), []
        for cover, _, first, last, label, chance in sorted(ranked):
            if not taken[first:last].any():
                taken[first:last] = True
                out.append((first, last, label, chance, -cover))
        return sorted(out)

    def scan(self, texts: pa.Array, least_probability: float = 0.5) -> list[tuple[int, str, str, float, float]]:
        """(text, paragraph number, family or unknown, probability, cover) of paragraphs not taken for prose."""
        lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
        flat = lines.flatten()
        split = pc.utf8_split_whitespace(pc.utf8_lower(flat))
        coded = split.flatten().dictionary_encode()
        place = self.place
        known = np.array([place.get(w, -1) if w in place else place.get(w.strip(".,;:()[]\"'"), -1) for w in coded.dictionary.to_pylist()] or [-1], np.int64)
        ids = known[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        owner, at = self.found(ids, np.repeat(np.arange(len(flat)), sizes))
        touched, owner = np.unique(owner, return_inverse=True)
        chances = self.probabilities(len(touched), owner, at)
        best = chances.argmax(1)
        text_of = np.repeat(np.arange(len(texts)), counts)
        single = {}
        for i in np.flatnonzero(best != len(TEMPLATES)).tolist():
            line = int(touched[i])
            _, cover = self.confirm(paragraph_words(flat[line].as_py()), FAMILIES[best[i]])
            single[line] = (int(best[i]), float(chances[i, best[i]]), cover)
        joined = []
        stream, line_of = self.word_stream(split)
        for first, last, label, chance, cover in self.confirmed_runs(stream, line_of, text_of, least_probability):
            run = range(int(line_of[first]), int(line_of[last - 1]) + 1)
            rivals, loose = [], []
            for line in run:
                if line not in single:
                    continue
                if single[line][1] < least_probability or single[line][2] < LEAST_COVER:
                    loose.append(line)
                    continue
                # A line that is confirmed without the run's words is a notice of its own.
                low, high = np.searchsorted(line_of, [line, line + 1]).tolist()
                outside = stream[low:high].copy()
                outside[max(first - low, 0) : max(last - low, 0)] = -1
                if self.cover(outside, single[line][0]) < LEAST_COVER:
                    rivals.append(line)
            if all(cover > single[line][2] for line in rivals):
                for line in rivals + loose:
                    del single[line]
                joined.append((run[0], label, chance, cover))
        first_line = np.cumsum(counts) - counts
        return [(int(text_of[line]), line - int(first_line[text_of[line]]), FAMILIES[label], chance, cover) for line, label, chance, cover in sorted([(line, *x) for line, x in single.items()] + joined)]


def other_paragraphs(docs: DataFrame, text_column: str = "text", most: int = TRAINING_PARAGRAPHS) -> list[str]:
    """A bounded sample of the corpus' paragraphs for the unknown class.

    Texts are chosen by a hash, and of each the paragraphs with the smallest hashes, so texts of any length
    take part and no long one fills the sample.
    """
    texts = docs.where(docs[text_column].isNotNull()).select(docs[text_column].alias("text"))
    total = texts.count()
    if not total:
        return []
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    some = texts.where(place < int((1 << 30) * min(1.0, most / 4 / total)))
    lines = some.select(F.explode(F.slice(F.sort_array(F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("line")))), 1, 8)).alias("x"))
    return [r["line"] for r in lines.select("x.h", "x.line").orderBy("h", "line").limit(most).collect()]


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_probability: float = 0.5, training_paragraphs: int = TRAINING_PARAGRAPHS) -> DataFrame:
    """Licences that each whole text names: id, licenses, n_paragraphs, n_confirmed, n_unconfirmed, found.

    A paragraph is a line, or the adjacent lines (up to one without words) over which a notice is wrapped; it
    is numbered by its first line, and n_paragraphs counts lines. Where the classifier's calibrated probability of a family is least_probability
    or more and a template of that family is covered by LEAST_COVER or more, the family is confirmed and
    named in licenses (sorted, joined by commas, empty if none); other paragraphs that look like a licence count
    as unconfirmed. found lists paragraph:family:probability of the confirmed ones. A null text counts as
    empty; rows are scanned one by one, so repeats, ties and null ids don't matter; an empty table gives
    no rows; other columns are not read. One narrow pass; the model depends on TEMPLATES and a bounded
    sample of paragraphs.
    """
    model = Model(other_paragraphs(docs, text_column, training_paragraphs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2_000_000):
            texts = part.column("text")
            found: list[list[tuple[int, str, float]]] = [[] for _ in range(len(texts))]
            other = [0] * len(texts)
            for at, paragraph, family, chance, cover in model.scan(texts, least_probability):
                if chance >= least_probability and cover >= LEAST_COVER:
                    found[at].append((paragraph, family, chance))
                else:
                    other[at] += 1
            columns = [
                pa.array([",".join(sorted({f for _, f, _ in x})) for x in found], pa.string()),
                pc.add(pc.count_substring(pc.fill_null(texts, ""), "\n"), 1).cast(pa.int64()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array(other, pa.int64()),
                pa.array([",".join(f"{p}:{f}:{c:.3f}" for p, f, c in x) for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=[id_column, "licenses", "n_paragraphs", "n_confirmed", "n_unconfirmed", "found"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(lean(run), f"`{id_column}` {kind}, licenses string, n_paragraphs bigint, n_confirmed bigint, n_unconfirmed bigint, found string")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_documents(spark, sf_dir))
