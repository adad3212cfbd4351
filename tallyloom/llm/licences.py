"""Licence scans by a trained paragraph classifier with template confirmation.

A paragraph is a line, or a window of a long line or of a block of lines that no blank line parts, which finds notices
inside long lines and notices wrapped over several. It is described by the word n-grams of one to three words that occur
in the licence templates, each present or not.
Sparse logistic regression, trained in numpy on noisy copies of the templates against a bounded sample of ordinary
paragraphs, gives the probability of each licence family and of the class of unknown paragraphs, calibrated by a
temperature on copies that training didn't see. A predicted family is confirmed by comparison with its templates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import frugal, small_batches, text_slices

# Wording of common licence notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Distributed under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc0-1.0": ("Released under CC0 1.0 Universal.", "This work has been dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nc-sa-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nd-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "gpl-2.0": ("Licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"),
    "mpl-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
}

FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
#: Sentences that share words with the templates and name no family.
NEAR_MISSES = (
    "The above copyright notice applies to all of this.", "This work is released to the public in any form.", "All rights reserved.", "You can use, copy and distribute it with or without a fee.",
    "A driving license is required by law.", "Permission is granted to any person with a copy of the notice.", "Published by the foundation under the terms of the agreement.",
    "The license of this file is found in the following list.", "Software is free of charge for any purpose.", "version 3 of the software, or any later version", "See the public library for a copy of the work.",
)
#: Ordinary documents whose paragraphs are sampled as unknown ones, paragraphs of one of them, and noisy copies of a template.
SAMPLE_DOCUMENTS, SAMPLE_PARAGRAPHS, COPIES = 300, 8, 14
#: Characters of a sampled paragraph that the fit reads.
SAMPLE_CHARACTERS = 4_000
#: Words of a window and of its step. A family is confirmed over a window and its two neighbours, so every notice of up to
#: 96 words lies whole in one of those spans.
WINDOW, STEP = 64, 32
STEPS, RATE, RIDGE = 150, 0.05, 1e-4
SEED = 5
#: The least probability of a family, and the least share of a template's word pairs that a paragraph holds (or, for part of a
#: long template, of the paragraph's own pairs that the template holds, if there are enough of them).
LEAST_PROBABILITY, LEAST_HELD, LEAST_OWN, ENOUGH_PAIRS = 0.5, 0.75, 0.9, 8
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str) -> list[bytes]:
    return [w for w in (x.lower().strip(_PUNCTUATION) for x in text.encode().split()) if w]


@dataclass
class Vocabulary:
    """The templates' words and n-grams. ``pair`` and ``triple`` give an n-gram's feature by its words, 0 for none."""

    words: dict[bytes, int]
    pair: np.ndarray
    triple: np.ndarray
    features: int

    @classmethod
    def build(cls, texts: list[list[bytes]]) -> Vocabulary:
        words: dict[bytes, int] = {}
        for text in texts:
            for word in text:
                words.setdefault(word, len(words) + 1)
        size = len(words) + 1
        pair, count = np.zeros((size, size), dtype=np.int32), size
        for text in texts:
            for a, b in zip(text, text[1:]):
                if not pair[words[a], words[b]]:
                    pair[words[a], words[b]] = count
                    count += 1
        triple = np.zeros((count - size + 1, size), dtype=np.int32)
        pairs = size
        for text in texts:
            for a, b, c in zip(text, text[1:], text[2:]):
                at = pair[words[a], words[b]] - pairs + 1, words[c]
                if not triple[at]:
                    triple[at] = count
                    count += 1
        return cls(words, pair, triple, count)

    def grams(self, words: np.ndarray, units: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and the units (or, of their first words, the ``places``) that hold them, of all words end to end; and
        which of them are pairs."""
        size, n = len(self.words) + 1, len(words)
        if not n:
            return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=bool),)
        pair = np.zeros(n, dtype=np.int64)
        same = units[1:] == units[:-1]
        pair[:-1] = np.where(same, self.pair[words[:-1], words[1:]], 0)
        triple = np.zeros(n, dtype=np.int64)
        at = np.flatnonzero((pair[:-2] > 0) & (pair[1:-1] > 0)) if n > 2 else np.zeros(0, dtype=np.int64)
        triple[at] = self.triple[pair[at] - size + 1, words[at + 2]]
        features = np.concatenate([words.astype(np.int64), pair, triple])
        owners = np.tile(units if places is None else places, 3)
        kinds = np.repeat([False, True, False], n)
        real = features > 0
        return features[real], owners[real], kinds[real]


@dataclass
class Classifier:
    vocabulary: Vocabulary
    weights: np.ndarray  # features x (families and unknown)
    bias: np.ndarray
    temperature: float
    templates: list[tuple[int, np.ndarray]]  # family and pairs

    def probabilities(self, features: np.ndarray, owners: np.ndarray, units: int) -> np.ndarray:
        """Of every unit from 0, by the features it holds; how often it holds one makes no difference, as in the fit."""
        held = np.unique(owners.astype(np.int64) * self.vocabulary.features + features)
        unit, feature = np.divmod(held, self.vocabulary.features)
        logits = np.zeros((units, UNKNOWN + 1), dtype=np.float32)
        if len(held):
            at = np.flatnonzero(np.diff(unit, prepend=-1))
            logits[unit[at]] = np.add.reduceat(self.weights[feature], at, axis=0)
        return _softmax((logits + self.bias) / np.float32(self.temperature))

    def best_template(self, family: int, pairs: set[int]) -> tuple[float, np.ndarray]:
        """The best agreement of a paragraph's known pairs with a template of ``family``, and that template's pairs."""
        shares = [(sum(int(p) in pairs for p in template) / len(template), -k, template) for k, (own, template) in enumerate(self.templates) if own == family and len(template)]
        share, _, template = max(shares, key=lambda x: x[:2], default=(0.0, 0, np.zeros(0, dtype=np.int64)))
        return share, template

    def confirm(self, family: int, pairs: set[int]) -> float:
        return self.best_template(family, pairs)[0]

    def part_of(self, family: int, pairs: set[int], total: int) -> float:
        """The share of a paragraph's ``total`` pairs that one template of ``family`` holds."""
        return max((len(pairs & set(template.tolist())) / total for own, template in self.templates if own == family), default=0.0) if total else 0.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _units(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' lines as units: the words' numbers (0: not in a template), each word's unit, each unit's text, and its line."""
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    bounds = lines.offsets.to_numpy().astype(np.int64)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    split = pc.ascii_split_whitespace(lines.flatten())
    edges = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    known, blank = [], []
    for word in coded.dictionary.cast(pa.large_binary()).to_pylist():
        word = word.lower().strip(_PUNCTUATION)
        known.append(vocabulary.words.get(word, 0))
        blank.append(not word)
    place = coded.indices.to_numpy()
    words, empty = np.array(known, dtype=np.int32)[place], np.array(blank, dtype=bool)[place]
    unit = np.repeat(np.arange(len(owner)), np.diff(edges))
    return words[~empty], unit[~empty], owner, number


def train(background: list[str]) -> Classifier:
    """Fit on noisy copies of the templates and on ordinary paragraphs; those that hold a template are left out."""
    rng = np.random.default_rng(SEED)
    texts = [(FAMILIES.index(f), words_of(t)) for f in FAMILIES for t in TEMPLATES[f]]
    vocabulary = Vocabulary.build([t for _, t in texts])
    empty = Classifier(vocabulary, np.zeros((vocabulary.features, UNKNOWN + 1), dtype=np.float32), np.zeros(UNKNOWN + 1, dtype=np.float32), 1.0, [])
    for family, text in texts:
        numbers = np.array([vocabulary.words[w] for w in text], dtype=np.int32)
        features, _, pairs = vocabulary.grams(numbers, np.zeros(len(numbers), dtype=np.int64))
        empty.templates.append((family, np.unique(features[pairs])))

    ordinary = [w for w in map(words_of, background) if w]
    samples: list[tuple[int, list[bytes]]] = []
    for family, text in texts:
        for copy in range(COPIES):
            words = list(text)
            if len(words) > 14 and copy % 3 == 2:  # a line of a long notice
                start = int(rng.integers(0, len(words) - 9))
                words = words[start : start + int(rng.integers(9, 15))]
            if len(words) > 6 and copy % 2:
                words.pop(int(rng.integers(len(words))))
            if ordinary and copy % 4 > 1:
                around = ordinary[int(rng.integers(len(ordinary)))]
                cut = int(rng.integers(0, len(around) + 1))
                words = around[max(0, cut - 20) : cut] + words + around[cut : cut + 20]
            samples.append((family, words))
    for words in ordinary:
        samples.append((UNKNOWN, words))
    samples += [(UNKNOWN, words_of(t)) for t in NEAR_MISSES for _ in range(COPIES)]
    numbers = [np.array([vocabulary.words.get(w, 0) for w in words], dtype=np.int32) for _, words in samples]
    units = np.repeat(np.arange(len(samples)), [len(x) for x in numbers])
    features, owners, pairs = vocabulary.grams(np.concatenate(numbers), units)
    label = np.array([f for f, _ in samples])
    held: dict[int, set[int]] = {}
    for feature, owner in zip(features[pairs].tolist(), owners[pairs].tolist()):
        held.setdefault(owner, set()).add(feature)
    usable = np.array([f != UNKNOWN or all(empty.confirm(k, held.get(i, set())) < 0.6 for k in range(UNKNOWN)) for i, f in enumerate(label)])

    x = np.zeros((len(samples), vocabulary.features), dtype=np.float32)
    x[owners, features] = 1
    fold = rng.random(len(samples)) < 0.8
    fit, check = np.flatnonzero(usable & fold), np.flatnonzero(usable & ~fold)
    target = np.eye(UNKNOWN + 1, dtype=np.float32)[label]
    model = Classifier(vocabulary, empty.weights, empty.bias, 1.0, empty.templates)
    moments = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(model.bias), np.zeros_like(model.bias)]
    alike: dict[tuple[int, bytes], list[int]] = {}  # samples of the same class and features, which are many, count as one row
    for i in fit.tolist():
        alike.setdefault((int(label[i]), np.packbits(x[i] > 0).tobytes()), []).append(i)
    rows = [members[0] for members in alike.values()]
    xs, ys = x[rows], target[rows]
    share = (np.array([len(members) for members in alike.values()], dtype=np.float32) / len(fit))[:, None]
    for step in range(1, STEPS + 1):
        error = (_softmax(xs @ model.weights + model.bias) - ys) * share
        for value, slope, first, second in ((model.weights, xs.T @ error + RIDGE * model.weights, *moments[:2]), (model.bias, error.sum(axis=0), *moments[2:])):
            first += np.float32(0.1) * (slope - first)
            second += np.float32(0.01) * (slope * slope - second)
            value -= np.float32(RATE) * (first / np.float32(1 - 0.9**step)) / (np.sqrt(second / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    if len(check):
        logits = x[check] @ model.weights + model.bias
        losses = {t: -np.log(np.maximum(_softmax(logits / np.float32(t))[np.arange(len(check)), label[check]], 1e-9)).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        model.temperature = min(losses, key=losses.get)
    return model


def _likely(chance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units that hold a family by its probability; every unit's family and its probability."""
    family = chance[:, :UNKNOWN].argmax(axis=1)
    top = chance[np.arange(len(chance)), family]
    return np.flatnonzero((top >= LEAST_PROBABILITY) & (top >= chance[:, UNKNOWN])), family, top


#: A find: the text's place, the line, the family, the probability and the agreement.
Find = tuple[int, int, int, float, float]


def _in_lines(model: Classifier, words: np.ndarray, unit: np.ndarray, owner: np.ndarray, number: np.ndarray) -> list[Find]:
    """Lines that are a notice, or a part of a long one, by themselves."""
    features, owners, pairs = model.vocabulary.grams(words, unit)
    # A family is confirmed by word pairs, so only lines with some need a probability.
    holders = np.unique(owners[pairs])
    slot = np.full(len(owner), -1)
    slot[holders] = np.arange(len(holders))
    real = slot[owners] >= 0
    out: list[Find] = []
    if len(holders):
        likely, family, top = _likely(model.probabilities(features[real], slot[owners[real]], len(holders)))
        pair_owner, pair_feature = owners[pairs], features[pairs]
        by = np.argsort(pair_owner, kind="stable")
        pair_owner, pair_feature = pair_owner[by], pair_feature[by]
        sizes = np.bincount(unit, minlength=len(owner))
        for i in likely:
            a, b = np.searchsorted(pair_owner, [holders[i], holders[i] + 1])
            own = set(pair_feature[a:b].tolist())
            held = model.confirm(int(family[i]), own)
            total = int(sizes[holders[i]]) - 1
            if held >= LEAST_HELD or (total >= ENOUGH_PAIRS and model.part_of(int(family[i]), own, total) >= LEAST_OWN):
                out.append((int(owner[holders[i]]), int(number[holders[i]]), int(family[i]), float(top[i]), held))
    return out


def _begin(places: np.ndarray, pairs: int) -> int:
    """Where the most of a template's known pairs begin to stand within the template's length (the first such place): a pair
    that ordinary words before the notice share with it is no beginning."""
    places = np.unique(places)
    return int(places[np.argmax(np.searchsorted(places, places + pairs) - np.arange(len(places)))])


def _in_windows(model: Classifier, words: np.ndarray, unit: np.ndarray, owner: np.ndarray, number: np.ndarray, known: list[Find]) -> list[Find]:
    """Of every block of lines and family, the first notice in its windows, unless a line of the block is known for the
    family. The line is that in which the notice's first known words stand."""
    n = len(words)
    if not n:
        return []
    first = np.ones(n, dtype=bool)
    first[1:] = (np.diff(unit) > 1) | (owner[unit[1:]] != owner[unit[:-1]])
    block, starts = np.cumsum(first) - 1, np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    ends = starts + sizes - 1
    last = np.maximum(0, -((WINDOW - sizes) // STEP))  # number of a block's last window
    offset = np.concatenate([[0], np.cumsum(last + 1)])
    wanted = (sizes > WINDOW) | (unit[ends] > unit[starts])  # a short line by itself is a paragraph already
    features, place, pairs = model.vocabulary.grams(words, block, np.arange(n))
    real = wanted[block[place]]
    features, place, pairs = features[real], place[real], pairs[real]
    pos = place - starts[block[place]]
    late = np.minimum(pos // STEP, last[block[place]])
    again = (late > 0) & (pos < (late - 1) * STEP + WINDOW)
    window = np.concatenate([late, late[again] - 1]) + offset[block[np.concatenate([place, place[again]])]]
    features, place, pairs = (np.concatenate([x, x[again]]) for x in (features, place, pairs))

    of_window = np.repeat(np.arange(len(sizes)), last + 1)
    count = np.bincount(window[pairs], minlength=len(of_window))
    near = count.copy()
    near[1:] += np.where(of_window[1:] == of_window[:-1], count[:-1], 0)
    near[:-1] += np.where(of_window[1:] == of_window[:-1], count[1:], 0)
    least = min(int(np.ceil(LEAST_HELD * len(t))) for _, t in model.templates if len(t))
    holders = np.flatnonzero((count > 0) & (near >= least))
    if not len(holders):
        return []
    slot = np.full(len(of_window), -1)
    slot[holders] = np.arange(len(holders))
    real = slot[window] >= 0
    likely, family, top = _likely(model.probabilities(features[real], slot[window[real]], len(holders)))
    by = np.lexsort((place[pairs], window[pairs]))
    pair_window, pair_feature, pair_place = window[pairs][by], features[pairs][by], place[pairs][by]
    found = {(int(t), int(f), int(k)) for t, k, f, _, _ in known}
    out: dict[tuple[int, int], Find] = {}
    for i in likely:
        w, f = int(holders[i]), int(family[i])
        at = int(of_window[w])
        if (at, f) in out:
            continue
        a, b = np.searchsorted(pair_window, [max(w - 1, offset[at]), min(w + 1, offset[at + 1] - 1) + 1])
        held, template = model.best_template(f, set(pair_feature[a:b].tolist()))
        text = int(owner[unit[starts[at]]])
        lines = range(int(number[unit[starts[at]]]), int(number[unit[ends[at]]]) + 1)
        if held >= LEAST_HELD and not any((text, f, k) in found for k in lines):
            begins = _begin(pair_place[a:b][np.isin(pair_feature[a:b], template)], len(template))
            out[at, f] = (text, int(number[unit[begins]]), f, float(top[i]), held)
    return list(out.values())


def find(model: Classifier, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every confirmed paragraph's text (by its place), line, family, probability and agreement, in order."""
    split = _units(texts, model.vocabulary)
    lines = _in_lines(model, *split)
    out = sorted(lines + _in_windows(model, *split, lines))
    columns = list(zip(*out)) if out else [()] * 5
    return tuple(np.array(c, dtype=k) for c, k in zip(columns, (np.int64, np.int64, np.int64, np.float64, np.float64)))


def fit(docs: DataFrame, *, sample_documents: int = SAMPLE_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit with paragraphs of at most ``sample_documents`` rows, those of the least hashes, as unknown ones.

    Up to ``SAMPLE_PARAGRAPHS`` lines of each are taken, evenly over its text, and of a line its first
    ``SAMPLE_CHARACTERS``; only these leave the tasks.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    some = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PARAGRAPHS - 1)), lambda i: F.get("_lines", F.floor(F.size("_lines") * i / SAMPLE_PARAGRAPHS).cast("int")))
    taken = F.when(F.size("_lines") > SAMPLE_PARAGRAPHS, some).otherwise(F.col("_lines"))
    mark = F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"), text_col).alias("_mark")
    rows = docs.select(F.col(id_col).alias("_id"), lines.alias("_lines"), mark).where("_id IS NOT NULL")
    short = rows.select("_id", "_mark", F.transform(taken, lambda x: F.substring(x, 1, SAMPLE_CHARACTERS)).alias("_taken"))
    # Rows above a bound on the hash stay in their tasks; the bound is raised until enough are below it.
    total, share = rows.count(), 4 * sample_documents
    while True:
        bound = min(2**63 - 1, (2**64 * share) // max(1, total) - 2**63)
        chosen = short.where(F.col("_mark") <= F.lit(bound)).orderBy("_mark", "_id").limit(sample_documents).collect()
        if len(chosen) >= min(sample_documents, total) or share >= total:
            break
        share *= 16
    return train([line for row in sorted(chosen, key=lambda r: (str(r["_id"]), r["_taken"])) for line in row["_taken"]])


def scan_licences(docs: DataFrame, model: Classifier | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that a licence family is confirmed for: ``doc_id, line, family, probability, agreement``.

    Every line is judged; of a long line, or a block of lines without a blank one between, so are overlapping windows,
    which add the first notice of each family that no line of the block has. ``line`` counts the text's lines from 0 and
    is where the notice begins. A null, empty or blank text has none. Repeated rows and null ids stay; texts are judged
    whole at any length; of equally likely families the first by name is taken. Other columns, whatever their names,
    aren't read. An empty table gives no rows; the model is then that of the templates alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(FAMILIES)
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                text, line, family, chance, held = find(sent.value, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(line), names.take(pa.array(family)), pa.array(chance), pa.array(held)], ["doc_id", "line", "family", "probability", "agreement"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(frugal(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line long, family string, probability double, agreement double")
