"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression on sparse word 1- to 3-grams assigns every paragraph to a licence family, to "unknown"
(licence talk of no known family) or to "none". It is trained on the driver from the templates below, varied at random
with a fixed seed, so it needs no labelled rows. A softmax temperature and the least probability for a family are
calibrated on sentences held out from training whole. What the classifier takes for licence talk is compared with the
templates; a family counts if the paragraph holds enough of one of its templates, and the classifier gives that stretch
to the family.

Paragraphs are the lines of a text, and windows of three lengths that slide over the words of the whole text across line
ends, so that hard-wrapped notices are found as well. Each has all families confirmed that it may hold; where two claim
the same stretch of words, the better match has it. All windows are scored at once, from sums of weights up to each word.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, text_str

# Opening statements of licences, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "This software is distributed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal, a public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "Copyright 2020. All rights reserved.",
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying is strictly prohibited.",
    ],
}
# Licence talk of no family above, and prose that uses the same words for other things.
UNKNOWN = [
    "Licensed under the terms of the Vendor Software License Agreement.",
    "Use of this material is governed by the license that came with it.",
    "Distributed under a custom license, see the file LICENSE for details.",
    "Permission to copy is granted under the conditions of the community license.",
    "This work is licensed under the terms of the Example Public License, version 7.",
    "Released under the Foo License.",
    "The code is available under the Shared Source License of the company.",
    "Copying is allowed if this notice and the name of the owner are kept with each copy.",
    "You may use and change the program under the conditions of the Artistic Agreement.",
    "The data are provided under the terms of use of the data portal, version 1.",
    "The licensor grants the licensee a right to use the software on one computer.",
    "See the accompanying licence terms before redistribution of this package.",
]
PROSE = [
    "He lost his driving license after the accident and had to walk to work.",
    "The version released last year was better than the first one.",
    "All members of the general public are welcome, free of charge.",
    "She works under the supervision of the foundation and has the right to vote.",
    "The rights of the workers were reserved for later talks.",
    "A copy of the letter was published by the free press in 1904.",
    "Persons obtaining a permit may use the road without restriction.",
    "The commons were open to all, and the work was hard.",
    "It may be modified at any time if the conditions are met.",
    "The software that we use at work is slow, and its licence is expensive.",
    "All of them came to the public library in person to get a copy of the book.",
    "The public was allowed to see the source of the river in the north.",
    "Under the law of the state the owner has to keep the road free.",
    "The terms of the contract were agreed upon in writing by both parties.",
]
FILLER = "the of and to a in is that it was for on with as be by at this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old between both life being under three never know same last another while us might great".split()
ORDINARY = frozenset(FILLER)
WORD = re.compile(r"[^\W\d_]+|[0-9]+(?:\.[0-9]+)*")
OTHER = "-"  # stands for a word of no training paragraph
CONFIRM = 0.7
TALK = 0.5  # a paragraph is licence talk if "none" has less than that before the temperature
WINDOWS = ((12, 4), (24, 8), (80, 20))  # words and step; the longest template and some more fit the largest


def grams(words: list[str]) -> list[str]:
    """All 1- to 3-grams of a training paragraph, as often as they stand there; OTHER is in none."""
    return [g for n in (1, 2, 3) for x in zip(*(words[i:] for i in range(n))) if OTHER not in x for g in (" ".join(x),)]


def varied(text: str, rng: random.Random) -> list[str]:
    """The words of a text with some lost and changed, between stretches of other words."""
    words = [w for w in WORD.findall(text.lower()) if rng.random() > 0.04]
    words = [rng.choice(FILLER) if rng.random() < 0.02 else w for w in words]
    around = [[rng.choice((*FILLER, OTHER)) for _ in range(rng.choice((0, 0, 0, 3, 12)))] for _ in range(2)]
    return around[0] + words + around[1]


@dataclass
class Scanner:
    classes: list[str]
    number: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    templates: dict[str, list[tuple[frozenset, frozenset]]] = field(default_factory=dict)
    lengths: dict[str, list[int]] = field(default_factory=dict)
    telling: dict[str, list[frozenset]] = field(default_factory=dict)  # words of a template that no other family has
    held_out: dict[str, float] = field(default_factory=dict)  # share of a class's unseen sentences taken for licence talk

    def __post_init__(self):
        self.known = {w for g in self.number for w in g.split()}

    def probabilities(self, words: list[str]) -> np.ndarray:
        return self.softmax(self.sums(words)[[-1]], np.zeros((1, len(self.classes) + 1)), self.temperature)[0]

    def sums(self, words: list[str]) -> np.ndarray:
        """Weights of the known grams that end before each place, summed up, and their number: a window's are a difference."""
        number, known = self.number, self.known
        at, hit = [], []
        one = two = None  # the words before, if they are in any gram
        for i, w in enumerate(words):
            if w not in known:
                one = two = None
                continue
            grams_here = (w,) if one is None else (w, f"{one} {w}") if two is None else (w, f"{one} {w}", f"{two} {one} {w}")
            for g in grams_here:
                k = number.get(g)
                if k is not None:
                    at.append(k)
                    hit.append(i)
            two, one = one, w
        out = np.zeros((len(words) + 1, len(self.classes) + 1))
        if at:
            where, first = np.unique(hit, return_index=True)
            out[where + 1, :-1] = np.add.reduceat(self.weights[at], first)
            out[where + 1, -1] = np.diff([*first, len(hit)])
        return out.cumsum(0)

    def softmax(self, ends: np.ndarray, starts: np.ndarray, temperature: float = 1.0) -> np.ndarray:
        """Class probabilities of the stretches between two places, from sums()."""
        x = ends - starts
        z = (self.bias + x[:, :-1] / np.sqrt(np.maximum(1.0, x[:, -1:]))) / temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def matches(self, words: list[str]) -> list[tuple[str, float, int]]:
        """(family, the share of a template's words and pairs that the paragraph has, number of the template) where it is enough.

        Of the words that no other family has (as "affero"), half must be there.
        """
        own, pairs = set(words), set(zip(words, words[1:]))
        out = []
        for family, templates in self.templates.items():
            for k, (w, p) in enumerate(templates):
                n, found = len(w) + len(p), len(w & own)
                if found + len(p) >= CONFIRM * n and (m := (found + len(p & pairs)) / n) >= CONFIRM and 2 * len((t := self.telling[family][k]) & own) >= len(t):
                    out.append((family, m, k))
        return out

    def stretches(self, family: str, k: int, words: list[str]) -> list[tuple[int, int]]:
        """Where a template lies in a paragraph: the first and the last run of about its length that have most of it, and in these the part with more pairs of the template than others."""
        w, p = self.templates[family][k]
        n = self.lengths[family][k]
        n += 2 + n // 8
        held = []
        for i in (x for x in range(len(words)) if words[x] in w):
            part = words[i : i + n]
            held.append((len(w.intersection(part)) + len(p.intersection(zip(part, part[1:]))), i))
        most = max(held)[0]
        out = set()
        for first in (min(i for m, i in held if m == most), max(i for m, i in held if m == most)):
            top, start, total, best = 0, first, 0, (first, min(first + n, len(words)))
            for x in range(first, min(first + n, len(words)) - 1):
                total += 1 if (words[x], words[x + 1]) in p else -1
                if total > top:
                    top, best = total, (start, x + 2)
                if total <= 0:
                    total, start = 0, x + 1
            out.add(best)
        return sorted(out)

    def confirmed(self, words: list[str]) -> list[tuple[str, float, float, int, int]]:
        """(family, probability, template match, from word, to word) of each family of which the paragraph holds a template, if the classifier takes that stretch for the family too."""
        found = []
        for family, m, k in self.matches(words):
            at = self.classes.index(family)
            for i, j in self.stretches(family, k, words):
                own = self.probabilities(words[i:j])
                if own[at] >= self.least and at == int(own[: len(self.templates)].argmax()):
                    found.append((family, float(own[at]), m, i, j))
                    break
        return found

    def notices(self, text: str) -> list[tuple[str, float, float]]:
        """(family or unknown, probability, template match) of each stretch of licence talk; a line counts once for each of its families.

        Every line and window is classified; those that are licence talk are compared with the templates.
        """
        words: list[str] = []
        line_of: list[int] = []
        spans: list[tuple[int, int]] = []
        for number, line in enumerate(text.lower().split("\n")):
            own = WORD.findall(line)
            if own:
                spans.append((len(words), len(words) + len(own)))
                words += own
                line_of += [number] * len(own)
        if not words:
            return []
        lines = len(spans)
        spans += sorted({(i, min(i + size, len(words))) for size, step in WINDOWS for i in range(0, max(1, len(words) - size + step), step)})
        at = np.array(spans)
        sums = self.sums(words)
        p = self.softmax(sums[at[:, 1]], sums[at[:, 0]])
        found: list[tuple[str, float, float, int, int]] = []
        unknown: dict[int, float] = {}
        for k in np.flatnonzero(p[:, -1] < TALK).tolist():
            i, j = spans[k]
            more = self.confirmed(words[i:j]) if j - i <= 2 * WINDOWS[-1][0] else []  # the windows cover a longer line
            found += [(f, x, m, i + a, i + b) for f, x, m, a, b in more]
            if k < lines and not more:
                unknown[line_of[i]] = max(float(1 - p[k, -1]), unknown.get(line_of[i], 0.0))
        return self.chosen(found, unknown, line_of)

    def chosen(self, found: list[tuple[str, float, float, int, int]], unknown: dict[int, float], line_of: list[int]) -> list[tuple[str, float, float]]:
        """Of families that claim the same words the better, and a family once a line; unknown talk only on other lines."""
        kept: list[tuple[str, float, float, int, int]] = []
        for x in sorted(set(found), key=lambda x: (-round(x[2], 2), -x[1], x)):
            family, _, _, i, j = x
            same = any(f == family and line_of[a] <= line_of[j - 1] and line_of[i] <= line_of[b - 1] for f, _, _, a, b in kept)
            if not same and not any(2 * (min(j, b) - max(i, a)) > min(j - i, b - a) for _, _, _, a, b in kept):
                kept.append(x)
        lines = {n for _, _, _, i, j in found for n in line_of[i:j]}
        return [x[:3] for x in sorted(kept, key=lambda x: x[3:])] + [("unknown", p, 0.0) for n, p in sorted(unknown.items()) if n not in lines]

    def scan(self, paragraph: str) -> tuple[str, float, float] | None:
        """The best of notices(); None if it's no licence talk."""
        found = self.notices(paragraph)
        return max([x for x in found if x[0] != "unknown"] or found, key=lambda x: (x[1], x[2], x[0]), default=None)


def regression(data: list[tuple[int, list[str]]], k: int, steps: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(gram numbers, weights, bias) of a multinomial logistic regression by full-batch Adam."""
    count: dict[str, int] = {}
    for _, words in data:
        for g in set(grams(words)):
            count[g] = count.get(g, 0) + 1
    # grams of ordinary words alone tell nothing
    number = {g: i for i, g in enumerate(sorted(g for g, n in count.items() if n >= 8 and not ORDINARY.issuperset(g.split())))}
    cols, row, val = [], [], []
    for r, (_, words) in enumerate(data):
        at = sorted(i for g in grams(words) if (i := number.get(g)) is not None)
        cols += at
        row += [r] * len(at)
        val += [1 / max(1.0, len(at)) ** 0.5] * len(at)
    cols, row, val = np.array(cols, np.int64), np.array(row, np.int64), np.array(val)
    one = np.eye(k)[[y for y, _ in data]]
    w, b = np.zeros((len(number), k)), np.zeros(k)
    starts = np.searchsorted(row, np.arange(len(data)))
    full = np.diff([*starts, len(row)]) > 0
    order = np.argsort(cols, kind="stable")
    cstart = np.searchsorted(cols[order], np.arange(len(number)))
    # families count alike, whatever the number of their rows; "none" as often as most paragraphs are no licence talk
    prior = np.ones(k)
    prior[-1] = NONE
    share = ((one / one.sum(0)) * prior).sum(1, keepdims=True) / prior.sum()
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, b)]
    for t in range(1, steps + 1):
        z = np.zeros((len(data), k))
        z[full] = np.add.reduceat(w[cols] * val[:, None], starts[full])
        z += b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - one) * share
        for x, m, v, grad in ((w, *moments[0], np.add.reduceat((g[row] * val[:, None])[order], cstart) + 1e-6 * w), (b, *moments[1], g.sum(0))):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            x -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return number, w, b


def varieties(rng: random.Random, each: int) -> list[tuple[int, int, list[str]]]:
    """(class, number of its source sentence, words)"""
    data = []
    for i, name in enumerate(CLASSES):
        for k, text in enumerate(TEMPLATES.get(name) or (UNKNOWN if name == "unknown" else PROSE)):
            data += [(i, k, varied(text, rng)) for _ in range(each)]
        if name == "none":
            # ordinary words between others that no sentence above has, and one or two words of licences (as "mit" in German)
            own = sorted({w for ts in TEMPLATES.values() for t in ts for w in WORD.findall(t.lower())})
            for k in range(each * 40):
                share = rng.random()
                words = [rng.choice(FILLER) if rng.random() < share else OTHER for _ in range(rng.randint(0, 80))]
                for w in rng.sample(own, rng.choice((0, 1, 1, 2))):
                    for _ in range(rng.choice((1, 1, 3))):
                        words.insert(rng.randint(0, len(words)), w)
                data.append((i, k, words))
    return data


CLASSES = [*TEMPLATES, "unknown", "none"]
NONE = 12.0
FOLDS = 3


@lru_cache(maxsize=1)
def train(seed: int = 11, each: int = 40, steps: int = 60) -> Scanner:
    """The scanner. What is calibrated (temperature, least probability) is so on sentences that the classifier hasn't seen in any variety.

    Families of one source only differ by short names; a held-out sentence can therefore be of no known family for the
    classifier, which is what the calibrated "unknown" is for.
    """
    data = varieties(random.Random(seed), each)
    k = len(CLASSES)
    y, z = [], []
    for fold in range(FOLDS):
        number, w, b = regression([(i, x) for i, n, x in data if n % FOLDS != fold], k, steps)
        part = Scanner(CLASSES, number, w, b, 1.0, 0.0)
        for i, n, x in data:
            if n % FOLDS == fold:
                s = part.sums(x)[-1]
                y.append(i)
                z.append(b + s[:-1] / max(1.0, s[-1]) ** 0.5)
    y, z = np.array(y), np.array(z)

    def probable(t: float) -> np.ndarray:
        p = np.exp(z / t - (z / t).max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=lambda t: -float(np.log(probable(t)[np.arange(len(y)), y] + 1e-300).mean()))
    p = probable(temperature)
    # the least probability that lets no more than 1 in 50 held-out sentences of no family pass as one
    outside = np.sort(p[y >= len(TEMPLATES)][:, : len(TEMPLATES)].max(1))
    least = float(min(0.9, max(0.3, outside[int(0.98 * (len(outside) - 1))])))
    number, w, b = regression([(i, x) for i, _, x in data], k, steps)
    templates = {f: [(frozenset(x), frozenset(zip(x, x[1:]))) for t in ts for x in [WORD.findall(t.lower())]] for f, ts in TEMPLATES.items()}
    telling = {f: [v.difference(*(u for g, x in templates.items() if g != f for u, _ in x)) for v, _ in ts] for f, ts in templates.items()}
    lengths = {f: [len(WORD.findall(t.lower())) for t in ts] for f, ts in TEMPLATES.items()}
    talk = {name: float((probable(1.0)[y == i][:, -1] < TALK).mean()) for i, name in enumerate(CLASSES)}
    return Scanner(CLASSES, number, w, b, temperature, least, templates, lengths, telling, talk)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, families (sorted, comma-joined), n_paragraphs (stretches of licence talk), family, probability, template_match.

    A line counts once for each family in it, a notice over several lines once. family is that of the most probable one, "unknown" if there is licence talk but none is confirmed,
    and null without any. Null and empty texts have none. Repeated rows and null ids stay as they are; an empty table
    gives an empty table; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(train())

    def fn():
        notices = model.value.notices

        def work(batch):
            found = [notices(text) for text in text_str(batch, text_col)]
            known = [[x for x in f if x[0] != "unknown"] for f in found]
            best = [max(k or f, key=lambda x: (x[1], x[0]), default=(None, None, None)) for k, f in zip(known, found)]
            return {
                id_col: batch.column(id_col),
                "families": [",".join(sorted({x[0] for x in k})) for k in known],
                "n_paragraphs": [len(f) for f in found],
                "family": [x[0] for x in best],
                "probability": [x[1] for x in best],
                "template_match": [x[2] for x in best],
            }

        return work

    return per_row(docs, [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")], f"`{id_col}` {kind}, families string, n_paragraphs long, family string, probability double, template_match double", fn)
