"""Licence scan of paragraphs, in DataFrame functions only.

A sparse logistic regression over the words and word pairs and triples of a paragraph names a licence
family, an unknown licence, or none. It is trained on the names and notices below: names in frames of
usual wordings, pieces of whole notices, for the unknown class those of licences that aren't among the
families and of invented ones, and for the class without a licence prose in four languages, sentences
that use the same words for other things, and notices with their words shuffled. An L1 penalty leaves a
few hundred n-grams with a weight, so a paragraph is scored by intersecting its n-grams with that
vocabulary. Every fourth piece is left out of the fit; on these the scores are calibrated by one
temperature, and the cut is the least one, at least a half, above which 98 in 100 pieces are licences.

A family is named where its probability reaches the cut; where only the probability of any licence does,
the licence is "unknown". A family is confirmed by one of its templates: a name that the paragraph has
whole, or a notice of which it has a good part.

A paragraph is what stands between blank lines; lines of up to 120 characters that follow one another
are joined, a longer one is a paragraph of its own.

Paragraphs that can't reach the cut are told by the model's own weights: from these follows a set of
words without any of which the n-grams left over don't sum to what a licence needs, even if a paragraph
had all of them. Every paragraph with one of these words is scored; for the others none is what the
model says.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of licence families, as notices write them (fixed values).
NAMES = {
    "mit": ("MIT", "MIT License", "MIT Licence", "MIT-style license", "Expat license", "MIT/X11 license"),
    "apache-2.0": ("Apache 2.0", "Apache-2.0", "Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2 license", "ASL 2.0"),
    "gpl": ("GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-or-later", "GNU GPL", "GNU GPL v3", "GNU General Public License", "GNU General Public License, version 2", "GNU General Public License, version 3"),
    "lgpl": ("LGPL", "LGPLv2", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "GNU LGPL", "GNU Lesser GPL", "GNU Lesser General Public License", "GNU Lesser General Public License, version 3"),
    "bsd": ("BSD", "BSD License", "BSD-style license", "BSD-2-Clause", "BSD-3-Clause", "BSD 2-Clause License", "BSD 3-Clause License", "new BSD license", "modified BSD license"),
    "mpl-2.0": ("MPL 2.0", "MPL-2.0", "MPLv2", "Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "cc-by-nc": ("CC BY-NC", "CC BY-NC 3.0", "CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by": ("CC BY", "CC BY 3.0", "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License"),
}
#: Names of other licences (fixed values); the fit learns from them what a licence of no family looks like.
OTHER_NAMES = (
    "AGPLv3", "AGPL", "GNU Affero General Public License", "EPL-2.0", "Eclipse Public License", "Eclipse Public License 1.0", "zlib license", "WTFPL", "Unlicense", "CDDL-1.0",
    "Common Development and Distribution License", "Artistic License", "Artistic-2.0", "Open Font License", "OFL-1.1", "Microsoft Public License", "Python license", "PostgreSQL license",
    "CC0 1.0", "CC BY-SA", "CC BY-SA 3.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-ND", "CC BY-ND 4.0", "CC BY-NC-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-SA", "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "Creative Commons Attribution-NonCommercial-NoDerivatives License", "Open Data Commons license", "Server Side Public License", "Business Source License 1.1", "Academic Free License", "Q Public License",
)
#: Whole notices of the families (fixed values).
NOTICES = {
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "cc-by-nc": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",),
    "cc-by": ("To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",),
}
#: Whole notices of other licences (fixed values).
OTHER_NOTICES = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary.",
    "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved.",
    "All rights reserved. This source code is proprietary and may not be copied, modified or distributed without a written license agreement.",
)
#: Wordings around a name (fixed values).
FRAMES = (
    "Available under {the} {}.", "Distributed under the {}.", "Distributed under the terms of {the} {}", "This package is made available under {the} {}", "Provided under {the} {}.", "Covered by {the} {}", "Subject to the terms of {the} {}.",
    "License: {}", "Licence {}", "{} applies to this file", "Use of this source code is governed by {the} {} that can be found in the LICENSE file.", "This project uses {the} {}", "{}, see the LICENSE file for details.",
    "The code is dual licensed under {}", "Text under {}", "Offered under {the} {}.", "Shared under {the} {}", "Released, as all of our work, under {the} {}.", "Images: {}", "SPDX-License-Identifier: {}", "Source: see above. SPDX-License-Identifier: {}", "SPDX-License-Identifier: {} Copyright holders", "{}", "{}.", "Everything in here is {} licensed.", "Published under {the} {}", "All files here are under {}.", "Released under {the} {} in the hope that it will be useful", "Licensed under {the} {} since version two",
)
#: Prose without a licence, much of it with words that notices use (fixed values).
OTHER = (
    "The committee will meet again in the spring to hear the report of the working group on public works.",
    "She opened the general store at nine and sold free copies of the local paper to any person who asked.",
    "The software version that we use in this project reads source files and writes binary forms of them.",
    "A driving license is required of every person who wants to rent a car at the airport.",
    "The court held that the terms of the contract were met and that no further conditions applied.",
    "Under the new rules, creative work at home is taxed like any other commercial income.",
    "This document describes how to install the library and how to report a problem with it.",
    "The foundation was published in an international list of common goods in version four of the report.",
    "You may obtain a copy of the timetable at the station or by writing to the office.",
    "Apache helicopters were seen over the valley, and the general public was asked to stay indoors.",
    "Researchers at MIT released a study of how students use public transport without paying for it.",
    "The novel was published under a pseudonym and is subject to much debate about poetic licence.",
    "The album was released under a small label, and the rights to it were sold at version three of the deal.",
    "The fishing licence is issued by the office of the general manager and covers the lake and the river.",
    "The parking lot is covered by cameras, subject to change, and made available to visitors at no charge.",
    "Her license plate was found under the bridge, and the notice said that all rights of way were closed.",
    "Code: 2.0 of the building rules applies to this house, see the file at the town hall for details.",
    "He kept the bar license in a frame and distributed copies of the permit to the press.",
    "Sie kam mit dem Zug und ging mit ihm unter der Brücke zur alten Stadt, wo das Haus mit dem Garten stand.",
    "Die Lizenz zum Fahren wurde mit der Zeit teurer, und die Version mit vier Rädern war nicht frei.",
    "Le livre est sous la table et la licence de pêche est dans le tiroir avec les autres papiers de la maison.",
    "La version de la historia que se publica en la revista es libre y la licencia de obra no es de nadie.",
    "The people said that one was in the house and that it is for the best to be on time with this.",
    "Der Mann und die Frau sind in der Stadt, und es ist nicht das erste Mal, dass sie mit dem Kind kommen.",
)
FAMILIES = tuple(NAMES)
UNKNOWN = "unknown"
_CLASSES = (*FAMILIES, UNKNOWN)


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def words_of(text: str) -> list[str]:
    """Lower-case runs of ASCII letters, digits, dots and hyphens, without a mark at either end."""
    return [w for w in (x.strip(".-") for x in re.findall(r"[a-z0-9.\-]+", text.lower())) if w]


@dataclass(frozen=True)
class Model:
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # n-grams x classes; class 0 has no licence
    biases: np.ndarray
    cut: float


def _invented(rng) -> str:
    parts = rng.choice(["ka", "lor", "mi", "ten", "dra", "vo", "sul", "per", "nix", "gam"], int(rng.integers(2, 4)))
    ending = rng.choice(["License", "Public License", "License 1.0", "Community License", "Source License, version 2", "-1.0"])
    return "".join(parts) + ("" if ending[0] == "-" else " ") + str(ending)


def _pieces(rng) -> tuple[list[list[str]], list[int]]:
    """Word lists and their classes: 0 for no licence, then the families, at last the unknown licences."""
    lists, labels = [], []
    noise = [w for t in OTHER for w in words_of(t)]

    def amid(words: list[str], most: int) -> list[str]:
        return [*rng.choice(noise, int(rng.integers(0, most))), *words, *rng.choice(noise, int(rng.integers(0, most)))]

    def add(words, label: int, most: int = 12) -> None:
        lists.append(amid(list(words), most))
        labels.append(label)

    for k, family in enumerate(_CLASSES, 1):
        for _ in range(1000 if family == UNKNOWN else 300):
            name = str(rng.choice(NAMES[family] if family in NAMES else OTHER_NAMES)) if family in NAMES or rng.random() < 0.6 else _invented(rng)
            frame = FRAMES[int(rng.integers(len(FRAMES)))].replace("{the}", str(rng.choice(["the", "the", "a", ""])))
            add(words_of(frame.replace("{}", name)), k, 40 if rng.random() < 0.3 else 8)
        for notice in NOTICES.get(family, OTHER_NOTICES):
            words = words_of(notice)
            for _ in range(60):
                n = int(rng.integers(max(6, len(words) // 3), len(words) + 1))
                at = int(rng.integers(0, len(words) - n + 1)) if rng.random() < 0.5 else 0
                add(words[at : at + n], k, 8)
            for _ in range(15):
                add(rng.permutation(words), 0)
        for name in NAMES.get(family, OTHER_NAMES[:12]):
            for _ in range(4):  # the name's words, but apart from each other
                words = [w for x in words_of(name) for w in (x, *rng.choice(noise, int(rng.integers(1, 4))))]
                if len(words_of(name)) > 1 or name == "MIT":
                    add(words, 0)
    for text in OTHER:
        words = words_of(text)
        for _ in range(50):
            n = int(rng.integers(3, len(words) + 1))
            at = int(rng.integers(0, len(words) - n + 1))
            add(words[at : at + n], 0)
    for frame in (f for f in FRAMES if "licen" not in f.lower()):
        for _ in range(12):
            add(words_of(frame.replace("{the}", "the").replace("{}", " ".join(rng.choice(noise, 2)))), 0)
    for _ in range(800):
        lists.append(list(rng.choice(noise, int(rng.integers(2, 60)))))
        labels.append(0)
    return lists, labels


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Sparse:
    """A matrix of zeros and ones, given by the columns of the ones in each row; no row and no column is empty."""

    def __init__(self, rows: list[list[int]], width: int):
        size = np.array([len(r) for r in rows])
        self.columns = np.concatenate([np.asarray(r) for r in rows])
        self.starts = np.cumsum(size) - size
        order = np.argsort(self.columns, kind="stable")
        self.rows = np.repeat(np.arange(len(rows)), size)[order]
        self.present, self.column_starts = np.unique(self.columns[order], return_index=True)
        self.width = width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.columns], self.starts, axis=0)

    def transposed(self, d: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, *d.shape[1:]))
        out[self.present] = np.add.reduceat(d[self.rows], self.column_starts, axis=0)
        return out

    def largest(self) -> float:
        """Largest eigenvalue of the matrix with its transpose, by power iteration."""
        v = np.ones(self.width)
        for _ in range(30):
            v = self.transposed(self.times(v))
            top = float(np.linalg.norm(v))
            v /= top
        return top


@functools.cache
def train(penalty: float = 3e-4, steps: int = 250, telling: float = 0.55, seed: int = 11) -> Model:
    """Fit by accelerated proximal gradient steps; every fourth piece is left out and calibrates scores and cut."""
    rng = np.random.default_rng(seed)
    lists, labels = _pieces(rng)
    sets = [sorted(set(grams(x))) for x in lists]
    y = np.array(labels)
    left_out = np.arange(len(y)) % 4 == 0
    seen: dict[str, list[int]] = {}
    for s, out, label in zip(sets, left_out, labels, strict=True):
        if not out:
            for g in s:
                seen.setdefault(g, [0, 0])[label > 0] += 1
    # N-grams that say little about whether there is a licence are words of the prose around.
    vocabulary = sorted(g for g, (none, some) in seen.items() if none + some >= 6 and abs(some - none) >= telling * (none + some))
    column = {g: i for i, g in enumerate(vocabulary)}
    rows = [[*(column[g] for g in s if g in column), len(vocabulary)] for s in sets]  # the last column is empty
    target = np.eye(len(_CLASSES) + 1)[y]
    fit, t = _Sparse([r for r, out in zip(rows, left_out, strict=True) if not out], len(vocabulary) + 1), target[~left_out]
    w = z = np.zeros((len(vocabulary) + 1, t.shape[1]))
    b, a, rate = np.zeros(t.shape[1]), 1.0, 2 * len(t) / fit.largest()
    for _ in range(steps):
        d = (_softmax(fit.times(z) + b) - t) / len(t)
        step = z - rate * fit.transposed(d)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[-1] = 0
        b = b - d.sum(axis=0)
        nxt = (1 + np.sqrt(1 + 4 * a * a)) / 2
        z, w, a = new + (a - 1) / nxt * (new - w), new, nxt
    used = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    z = _Sparse([r for r, out in zip(rows, left_out, strict=True) if out], len(w)).times(w) + b
    truth = y[left_out]
    loss = lambda heat: -np.log(_softmax(z / heat)[np.arange(len(truth)), truth] + 1e-12).mean()
    heat = min(np.linspace(0.2, 3.0, 57), key=loss)
    p = _softmax(z / heat)
    licence = 1 - p[:, 0]
    order = np.argsort(-licence, kind="stable")
    right = np.cumsum((truth > 0)[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(right >= 0.98)
    cut = max(0.5, float(licence[order[enough[-1]]]) if len(enough) else 1.0)
    return Model(tuple(vocabulary[i] for i in used), w[used].astype(float) / heat, b.astype(float) / heat, cut)


def _let(value: Column, body):
    return F.element_at(F.transform(F.array(value), body), 1)


def _array(values, kind: str) -> Column:
    """A constant array, written as one string so that the plan stays small."""
    return F.split(F.lit("\t".join(str(v) for v in values)), "\t").cast(f"array<{kind}>")


def _grams(text: Column) -> Column:
    words = F.filter(F.transform(F.split(F.lower(text), "[^a-z0-9.\\-]+"), lambda w: F.regexp_replace(w, "^[.\\-]+|[.\\-]+$", "")), lambda w: w != "")
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    triples = lambda w: F.transform(w, lambda a, i: F.concat(a, F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2)))
    return _let(words, lambda w: F.array_distinct(F.filter(F.concat(w, pairs(w), triples(w)), lambda g: g.isNotNull())))


def needed_words(model: Model) -> tuple[str, ...] | None:
    """Words of which every paragraph that reaches the cut has at least one; None where one can reach it without any.

    Licences reach the cut together only if the sum of one of them exceeds that of class 0 by the logit of
    the cut less the logarithm of their number. Words are taken until the gains of all n-grams without any
    of them don't add up to that for any class; long words that aren't in the other prose come first,
    since few paragraphs have them.
    """
    weights = np.round(model.weights, 6)
    gain = np.maximum(weights[:, 1:] - weights[:, :1], 0)
    need = np.log(model.cut / (1 - model.cut)) - np.log(len(_CLASSES)) - (model.biases[1:] - model.biases[0]) - 1e-6
    if (need <= 0).any():
        return None
    parts = [set(g.split(" ")) for g in model.vocabulary]
    prose = [set(words_of(t)) for t in OTHER]
    rare = {x: 1 / (1 + 10 * sum(x in p for p in prose)) / 3.0 ** max(0, 7 - len(x)) for p in parts for x in p}
    left, taken = np.ones(len(parts), bool), []
    while (over := gain[left].sum(axis=0) >= need).any():
        worth: dict[str, float] = {}
        for i in np.flatnonzero(left):
            for x in parts[i]:
                worth[x] = worth.get(x, 0.0) + float(gain[i][over].sum()) * rare[x]
        taken.append(max(sorted(worth), key=worth.__getitem__))
        left &= np.array([taken[-1] not in p for p in parts])
    return tuple(taken)


def _can_reach(text: Column, words: tuple[str, ...] | None) -> Column:
    if words is None:
        return F.lit(True)
    return F.rlike(F.lower(text), F.lit("(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in words) + ")(?![a-z0-9])")) if words else F.lit(False)


def _judge(model: Model, share: float):
    vocabulary = _array(model.vocabulary, "string")
    places = F.map_from_arrays(vocabulary, F.sequence(F.lit(1), F.lit(len(model.vocabulary))))
    families = F.array(*[F.lit(f) for f in FAMILIES])
    gram_sets = lambda texts: [_array(sorted(set(grams(words_of(t)))), "string") for t in texts]
    names, notices = ({f: gram_sets(kind[f]) for f in FAMILIES} for kind in (NAMES, NOTICES))

    def scored(line: Column, g: Column) -> Column:
        at = F.transform(F.array_intersect(g, vocabulary), lambda x: F.element_at(places, x))
        sums = lambda k, rows: F.aggregate(rows, F.lit(float(model.biases[k])), lambda a, i: a + F.get(_array(np.round(model.weights[:, k], 6), "double"), i - 1))
        odds = lambda rows: F.array(*[F.exp(sums(k, rows)) for k in range(len(_CLASSES) + 1)])

        def verdict(e: Column) -> Column:
            total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
            own = F.slice(e, 2, len(FAMILIES))
            best, licence = F.array_max(own) / total, 1 - F.element_at(e, 1) / total
            k = F.array_position(own, F.array_max(own)).cast("int")
            known = F.struct(F.element_at(families, k).alias("family"), best.alias("score"), _confirmed(g, k).alias("confirmed"), line.alias("paragraph"))
            other = F.struct(F.lit(UNKNOWN).alias("family"), licence.alias("score"), F.lit(False).alias("confirmed"), line.alias("paragraph"))
            return F.when(best >= model.cut, known).when(licence >= model.cut, other)

        return _let(at, lambda rows: _let(odds(rows), verdict))

    def _confirmed(g: Column, k: Column) -> Column:
        def part(t: Column) -> Column:
            common = F.size(F.array_intersect(g, t))
            return (common >= share * F.size(t)) | ((common >= share * F.size(g)) & (common > 5))

        out = F.lit(False)
        for i, f in enumerate(FAMILIES, 1):
            near = F.lit(False)
            for t in names[f]:
                near = near | (F.size(F.array_intersect(g, t)) == F.size(t))
            for t in notices[f]:
                near = near | part(t)
            out = out | ((k == i) & near)
        return out

    return scored


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: lines of up to 120 characters that follow one another are joined by a blank."""
    bare = F.regexp_replace(text, "\\n[ \\t\\r\\f\\x0b]+(?=\\n)", "\n")
    joined = F.regexp_replace(bare, "\\n(?<=(?:^|\\n)[^\\n]{1,120}\\n)(?=[^\\n]{1,120}(?:\\n|$))", " ")
    return F.split(joined, "\n+")


def license_scan(docs: DataFrame, text_col: str = "text", share: float = 0.6, model: Model | None = None) -> DataFrame:
    """Every row of ``docs`` with its licence paragraphs.

    New columns: findings (array of family, score, confirmed, paragraph, in the order of the text; the
    family may be "unknown", the score is the probability of the family or that of any licence, and a
    paragraph's joined lines have a blank between them), licenses (sorted distinct families of confirmed
    findings; unknown licences are never confirmed), n_findings and n_unconfirmed. Columns of ``docs`` with these names are replaced, others pass through. Null, empty
    and unlicensed texts have empty arrays. Equal rows get equal results; an empty table gives none.
    """
    new = ("findings", "licenses", "n_findings", "n_unconfirmed")
    model = model or train()
    judge, words = _judge(model, share), needed_words(model)
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.filter(paragraphs(text), lambda x: _can_reach(x, words))
    scored = F.filter(F.transform(lines, lambda x: _let(_grams(x), lambda g: judge(x, g))), lambda s: s.isNotNull())
    found = docs.select(*[c for c in docs.columns if c not in new], scored.alias("findings"))
    found = found.withColumn("findings", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)))
    kept = F.filter("findings", lambda s: s["confirmed"])
    return found.withColumns({"licenses": F.array_sort(F.array_distinct(F.transform(kept, lambda s: s["family"]))), "n_findings": F.size("findings").cast("long"), "n_unconfirmed": (F.size("findings") - F.size(kept)).cast("long")})
