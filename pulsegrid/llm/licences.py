"""Licence scan: a trained paragraph classifier, applied in DataFrame operations only.

A logistic regression over word one- and two-grams tells licence families and "unknown" apart. It is trained here, on notices
made from the templates below, on paragraphs of licence bodies whole and in pieces, and on lines of a bounded sample of the corpus, which are unknown unless they hold a part of a template. An L1 penalty makes it sparse: n-grams
without weight are dropped, and so is every n-gram that the unknown lines have. Temperature and the least probability of a family are set on held-out notices and held-out lines of the sample. A family is
reported only if one of its names stands in the text word by word, so a licence with another word in its name is unknown, or if the text shares most of its word pairs with a paragraph of its body (of the shorter one).

A paragraph is what lies between blank lines. Its lines are rated each and with the next one, so that a notice that is wrapped is found, and what is found of one family in a paragraph is one notice.

Texts are first searched for anchors, words of which every text that can be confirmed has one: of each name the word that is the rarest in the sample, and of each paragraph of a body so many that
no text shares enough of it without one. The search changes no result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.support import cut

UNKNOWN = "unknown"
#: Names by family, as notices write them; those of Creative Commons follow from their parts.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "Affero General Public License", "GNU AGPL v3", "AGPL-3.0 license", "AGPLv3"],
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0 license", "Apache Software License, version 2"],
    "Artistic": ["Artistic License 2.0", "Artistic License 1.0", "Artistic License"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "New BSD license", "3-clause BSD license", "2-clause BSD license"],
    "Boost": ["Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0 license"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero license", "CC0 license"],
    "EPL": ["Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License, version 1.0", "EPL-2.0 license"],
    "EUPL": ["EUPL-1.2", "EUPL v1.2", "EUPL 1.1", "European Union Public Licence", "European Union Public Licence, version 1.2"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GNU GPL v2", "GNU GPL", "GPL-3.0 license", "GPL-2.0 license", "GPLv3", "GPLv2", "GNU General Public License"],
    "ISC": ["ISC License", "ISC licence"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "GNU Library General Public License", "LGPL-2.1 license", "LGPL-3.0 license", "GNU LGPL v3", "LGPLv3"],
    "MIT": ["MIT License", "MIT license (Expat)", "MIT licence", "Expat License"],
    "MPL": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License", "MPL-2.0 license"],
    "OFL": ["SIL Open Font License", "SIL Open Font License, Version 1.1", "OFL-1.1 license"],
    "Unlicense": ["The Unlicense", "Unlicense license"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
_CC = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _long in _CC.items():
    NAMES[f"CC-{_short}"] = [f"Creative Commons {_long} license"] + [x for v in ("4.0", "3.0", "2.5", "2.0", "1.0") for x in (f"CC {_short} {v}", f"Creative Commons {_long} {v}")]
#: Identifiers that stand behind the words of SPDX headers.
SPDX = {
    "AGPL": ["AGPL-3.0"], "Apache": ["Apache-2.0"], "Artistic": ["Artistic-2.0", "Artistic-1.0"], "BSD": ["BSD-3-Clause", "BSD-2-Clause"], "Boost": ["BSL-1.0"], "CC0": ["CC0-1.0"], "EPL": ["EPL-2.0", "EPL-1.0"], "EUPL": ["EUPL-1.2", "EUPL-1.1"],
    "GPL": ["GPL-3.0", "GPL-2.0"], "ISC": ["ISC"], "LGPL": ["LGPL-3.0", "LGPL-2.1"], "MIT": ["MIT"], "MPL": ["MPL-2.0"], "OFL": ["OFL-1.1"], "Unlicense": ["Unlicense"], "Zlib": ["Zlib"],
}
for _family, _ids in SPDX.items():
    NAMES[_family] += [f"SPDX-License-Identifier: {x}" for x in _ids]
#: Paragraphs of licence bodies and headers, without what differs between works. The disclaimer that MIT and Unlicense share is MIT's.
BODIES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "CC-BY": ["You must give appropriate credit, provide a link to the license, and indicate if changes were made. You may do so in any reasonable manner, but not in any way that suggests the licensor endorses you or your use."],
    "CC-BY-NC": ["You may not use the material for commercial purposes. NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation."],
    "CC-BY-SA": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "CC0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "has waived all copyright and related or neighboring rights to this work.",
        "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
}
#: Words of a piece of a body in training, and the telling pairs that a text shares with a body at least, or all of a short one.
PIECE, LEAST_PAIRS = 12, 5
FRAMES = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "This software is made available under the {}.", "Published under a {}, see the file for details.", "You may use this file under the {}.", "License: {}"]
RESERVED = ["All rights reserved.", "All rights are reserved.", "Copyright 2020 Example Inc. All rights reserved.", "Copyright (c) the authors, all rights reserved worldwide.", "No part may be reproduced. All rights reserved."]
OTHER = [
    "This work is done under the terms of the day.", "The version of the file was released under the new name.", "You may use this software for the work, see the details.", "All of the work is made available to the public in general.", "The international version is public, the commercial one is not.",
    "The driver has a license plate and a driving licence.", "License plates are made under the new terms.", "The general public may see the work at 4.0 and 3.0 points.", "He wrote a clause by clause account in part 2 and part 3.", "Attribution of the work to the authors is new.", "The table is reserved for two and all seats are taken.",
    "Creative work is common in the public library.", "Mozilla and Apache are names of a browser and of a people.", "The lesser part was published in version 2.", "MIT is an institute in the city, and so is the BSD group.", "The rights of all people are in the file.", "Copyright law is a part of the law.", "Reserved words of the language are not free for use.", "They by then may share alike what is not for sale.",
    "the of and to in is this that for it with as was on are be by an or not no new you he a", "la le de des et que en un une el los las y para der die das und mit von ist",
]
#: Too frequent to search for: an n-gram needs another word.
STOP = frozenset(
    "a about above all along also an and any anyone are as at authors available be been before being but by c can conditions copyright could details did do does each either else even example file following for free from had has have he her here his how if in inc into international is it its law least made made may means "
    "might more most must name names neither new no nor not of on one only or other our out own part people public published purpose released reproduced same see shall she should so software some such terms than that the their them then there these they this those through to under until up use version was we were "
    "what when where which who whom will with without work worldwide would you your".split()
)
_TOKEN = r"[a-z0-9]+"
#: Words that names have or lack as they like.
_LOOSE = ("v", "version", "the")
#: Between paragraphs.
BLANK = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"
#: Bounds of the sample of the corpus: documents, lines of each, characters of each line.
SAMPLE = (500, 20, 300)


def _words_of(text: str) -> list[str]:
    words = ["license" if w == "licence" else re.sub(r"^v([0-9]+)$", r"\1", w) for w in re.findall(_TOKEN, text.lower())]
    return [w for w in words if w not in _LOOSE]


def _grams(text: str) -> list[str]:
    words = _words_of(text)
    return sorted(set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])})


def _pairs(words: list[str]) -> set[str]:
    """Pairs of neighbours of which one at least isn't a word of STOP."""
    return {f"{a} {b}" for a, b in zip(words, words[1:]) if not {a, b} <= STOP}


@lru_cache(1)
def templates() -> dict[str, tuple[list[str], list[list[str]]]]:
    """By family its names as words with single spaces, and the distinct telling word pairs of each paragraph of its bodies."""
    names = {family: sorted({" ".join(_words_of(n)) for n in own}) for family, own in NAMES.items()} | {"Reserved": ["all rights reserved", "all rights are reserved"]}
    return {family: (own, [sorted(_pairs(_words_of(t))) for t in BODIES.get(family, [])]) for family, own in names.items()}


def overlap_of(text: str, family: str) -> float:
    """1 if a name of the family stands in the text; else the largest share of telling word pairs in common with a paragraph of its body, of the shorter one."""
    names, bodies = templates()[family]
    words = _words_of(text)
    if any(f" {n} " in f" {' '.join(words)} " for n in names):
        return 1.0
    own = _pairs(words)
    common = [(len(own & set(b)), len(b)) for b in bodies]
    return max((c / min(len(own), n) for c, n in common if c >= min(LEAST_PAIRS, n)), default=0.0)


@dataclass
class LicenceModel:
    classes: list[str]
    grams: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float
    least: float
    anchors: list[str]

    def probabilities(self, text: str) -> np.ndarray:
        place = {g: k for k, g in enumerate(self.grams)}
        z = (self.intercepts + sum((self.weights[place[g]] for g in _grams(text) if g in place), np.zeros(len(self.classes)))) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def examples() -> tuple[list[str], list[str]]:
    """Texts and their families: names alone and in frames by turns, paragraphs of bodies whole and in pieces, and the sentences of other meaning, alone and in pairs."""
    made = [(FRAMES[(k + j) % len(FRAMES)].format(name), family) for family, names in NAMES.items() for k, name in enumerate(names) for j in range(0, len(FRAMES), 2)]
    made += [(name, family) for family, names in NAMES.items() for name in names for _ in range(2)]
    for family, bodies in BODIES.items():
        for body in bodies:
            words = body.split()
            made += [(body, family)] * 2 + [(" ".join(words[k : k + PIECE]), family) for k in range(0, max(len(words) - PIECE // 2, 1), PIECE // 2)]
    made += [(text, "Reserved") for text in RESERVED for _ in range(6)]
    made += [(text, UNKNOWN) for text in OTHER for _ in range(4)] + [(f"{a} {b}", UNKNOWN) for a, b in zip(OTHER, OTHER[3:] + OTHER[:3])]
    return [t for t, _ in made], [c for _, c in made]


def sample_lines(docs: DataFrame, bounds: tuple[int, int, int] = SAMPLE) -> tuple[str, ...]:
    """Lines of the documents (doc_id, text) with the smallest hashes of id and text, spread over each text, within the bounds: what the driver gathers is some megabytes, whatever the corpus."""
    documents, lines, size = bounds
    keyed = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("key"), "text")
    last = [r.key for r in keyed.select("key").distinct().orderBy("key").limit(documents).collect()]
    if not last:
        return ()
    split = F.split("text", "\n")
    step = F.greatest(F.ceil(F.size(split) / lines), F.lit(1))
    own = keyed.where(F.col("key") <= last[-1]).select("key", F.transform(F.filter(split, lambda x, k: k % step == 0), lambda x: F.substring(x, 1, size)).alias("lines"))
    found = own.groupBy("key").agg(F.first("lines").alias("lines")).orderBy("key").collect()
    return tuple(dict.fromkeys(x for r in found for x in r.lines if x.strip()))


@lru_cache(4)
def train(sample: tuple[str, ...] = (), rounds: int = 160, rate: float = 2.0, penalty: float = 2e-4, hold: int = 5) -> LicenceModel:
    """Multinomial logistic regression with L1 (proximal gradient), on the driver: about 2000 short texts and the lines of a bounded sample of the corpus. Every
    `hold`-th example and line is held out for calibration. Lines of the sample that hold a part of a name or half of a paragraph of a body are left out."""
    texts, families = examples()
    classes = sorted(set(families) - {UNKNOWN}) + [UNKNOWN]
    parts = {g for own, _ in templates().values() for n in own for g in _grams(n) if " " in g and any(w not in STOP and not w.isdigit() for w in g.split())}
    bodies = {p for _, own in templates().values() for b in own for p in b}
    lines = [x for x in sample if not parts.intersection(own := _grams(x)) and (bodies.isdisjoint(own) or max(overlap_of(x, c) for c in classes[:-1]) < 0.5)]
    strange = [set(_grams(x)) for k, x in enumerate(lines) if k % hold]
    found = [set(_grams(t)) for t in texts]
    other = set().union(*(g for g, c in zip(found, families, strict=True) if c == UNKNOWN), *strange)
    telling = lambda g: [w for w in g.split() if w not in STOP and not w.isdigit()]
    grams = sorted(g for g in set().union(*found) - other if telling(g))
    place = {g: k for k, g in enumerate(grams)}

    def rows(sets: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(sets), len(grams)), np.float32)
        for k, own in enumerate(sets):
            out[k, [place[g] for g in own if g in place]] = 1
        return out

    x, y = rows(found), np.array([classes.index(c) for c in families])
    fit, held = np.arange(len(y)) % hold != 0, np.arange(len(y)) % hold == 0
    w, b = np.zeros((len(grams), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    # the sample's lines have no n-gram that is left: they are one row that counts for many
    x_fit, gold = np.vstack([x[fit], np.zeros((1, len(grams)), np.float32)]), np.eye(len(classes), dtype=np.float32)[np.append(y[fit], len(classes) - 1)]
    count = np.append(np.ones(fit.sum(), np.float32), min(len(strange), fit.sum() // 2))[:, None]

    def soft(z: np.ndarray, t: float = 1.0) -> np.ndarray:
        z = np.exp(z / t - (z / t).max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    for _ in range(rounds):
        miss = (soft(x_fit @ w + b) - gold) * count / count.sum()
        w -= rate * (x_fit.T @ miss)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        b -= rate * miss.sum(0)
    w, b = w.astype(np.float64), b.astype(np.float64)
    calm = rows([set(_grams(t)) for k, t in enumerate(lines) if k % hold == 0])
    z, goals = np.vstack([x[held], calm]) @ w + b, np.append(y[held], np.full(len(calm), len(classes) - 1))
    scales = np.linspace(0.3, 3, 28)
    temperature = float(scales[np.argmin([-np.log(soft(z, t)[np.arange(len(z)), goals] + 1e-12).mean() for t in scales])])
    stranger = soft(z, temperature)[goals == len(classes) - 1, :-1].max(initial=0.0)
    used = np.flatnonzero(np.abs(w).sum(1))
    grams, w = [grams[k] for k in used], w[used]
    often: dict[str, int] = {}
    for x in sample:
        for word in set(_words_of(x)):
            often[word] = often.get(word, 0) + 1
    return LicenceModel(classes, grams, w, b, temperature, float(min(0.9, max(0.5, stranger))), _anchors(often))


def _anchors(often: dict[str, int]) -> list[str]:
    """Words of which a text that is confirmed has one: the rarest of each name, and of each paragraph of a body so many of the rarest that fewer of its word pairs are without one than a text has to share with it."""
    rarest = lambda words: min((w for w in words if not w.isdigit()), key=lambda w: (w in STOP, often.get(w, 0), -len(w), w))
    found = {rarest(name.split()) for names, _ in templates().values() for name in names}
    for _, bodies in templates().values():
        for pairs in bodies:
            while len(left := [p for p in pairs if not found.intersection(p.split())]) >= min(LEAST_PAIRS, len(pairs)):
                found.add(rarest({w for p in left for w in p.split()}))
    return sorted(found)


def _words(text: Column) -> Column:
    plain = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({_TOKEN})"), F.lit(1)), lambda w: F.when(w == "licence", "license").otherwise(F.regexp_replace(w, "^v([0-9]+)$", "$1")))
    return F.filter(plain, lambda w: ~w.isin(*_LOOSE))


def _branches(words: set[str]) -> str:
    """A pattern for whole words, branching letter by letter, so that a word is left at the first letter that none goes on with."""
    heads = sorted({w[0] for w in words if w})
    pattern = "|".join(c + _branches({w[1:] for w in words if w[:1] == c}) for c in heads)
    pattern = f"(?:{pattern})" if len(heads) > 1 or "" in words and heads else pattern
    return f"{pattern}?" if "" in words and heads else pattern


def anchor_pattern(model: LicenceModel) -> str:
    """Anchors as words, whatever their case; licence is read as license."""
    return f"(?i)(?<![a-z0-9])(?:{_branches({*model.anchors, *(['licence'] if 'license' in model.anchors else [])})})(?![a-z0-9])"


def licence_paragraphs(docs: DataFrame, model: LicenceModel | None = None, overlap: float = 0.75) -> DataFrame:
    """doc_id, text_key, paragraph (its place from 0), family, probability, overlap of each notice that is found in docs (doc_id, text); probability and overlap are the largest of its lines.

    Paragraphs lie between blank lines; each line, and each with the next one of its paragraph, is rated. The model's n-grams and weights, some hundred rows, are broadcast.
    """
    model = model or train(sample_lines(docs))
    spark, anchored = docs.sparkSession, anchor_pattern(model)
    some = docs.where(F.col("text").rlike(anchored)).select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", BLANK)).alias("paragraph", "block")).where(F.col("block").rlike(anchored))
    lines = F.split("block", "\n")
    both = F.transform(lines, lambda x, k: F.array(F.struct((2 * k).alias("at"), x.alias("body")), F.struct((2 * k + 1).alias("at"), F.concat(x, F.lit(" "), F.get(lines, k + 1)).alias("body"))))
    some = some.select("doc_id", "text_key", "paragraph", F.explode(F.flatten(both)).alias("unit")).select("doc_id", "text_key", "paragraph", "unit.at", "unit.body")
    some = some.where(F.col("body").rlike(anchored)).withColumn("words", _words(F.col("body"))).drop("body")
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    key = ["doc_id", "text_key", "paragraph", "at"]
    grams = some.select(*key, "words", F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram"))
    weights = spark.createDataFrame([(g, [float(v) for v in row]) for g, row in zip(model.grams, model.weights, strict=True)], "gram string, weights array<double>")
    scored = grams.join(F.broadcast(weights), "gram")
    sums = scored.groupBy(*key).agg(*[F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(len(model.classes))], F.first("words").alias("words"))
    z = F.array(*[(F.col(f"z{k}") + F.lit(float(b))) / F.lit(model.temperature) for k, b in enumerate(model.intercepts)])
    rated = sums.select(*key, "words", z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    rated = rated.select(*key, "words", F.array_position("z", F.col("top")).cast("int").alias("place"), (1 / total).alias("probability")).where(F.col("probability") >= model.least)
    known = spark.createDataFrame([(k + 1, c, *templates()[c]) for k, c in enumerate(model.classes) if c != UNKNOWN], "place int, family string, names array<string>, bodies array<array<string>>")
    phrase = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    stop = lambda w: w.isin(*sorted(STOP))
    own = F.array_distinct(F.array_compact(F.zip_with("words", F.slice("words", 2, 1 << 30), lambda a, b: F.when(b.isNotNull() & ~(stop(a) & stop(b)), F.concat_ws(" ", a, b)))))

    def body_share(b: Column) -> Column:
        common = F.size(F.array_intersect(own, b))
        return F.when(common >= F.least(F.lit(LEAST_PAIRS), F.size(b)), common / F.least(F.size(own), F.size(b))).otherwise(0.0)

    share = F.when(F.exists("names", lambda n: F.contains(phrase, F.concat(F.lit(" "), n, F.lit(" ")))), 1.0).otherwise(F.coalesce(F.array_max(F.transform("bodies", body_share)), F.lit(0.0)))
    named = rated.join(F.broadcast(known), "place").select(*key[:3], "family", "probability", share.alias("overlap")).where(F.col("overlap") >= overlap)
    return named.groupBy(*key[:3], "family").agg(F.max("probability").alias("probability"), F.max("overlap").alias("overlap"))


def scan(docs: DataFrame, model: LicenceModel | None = None, overlap: float = 0.75) -> DataFrame:
    """doc_id, n_paragraphs, n_notices, families (sorted, comma-joined; empty if none) for each row of docs (doc_id, text; other columns are ignored).

    Paragraphs are separated by blank lines; those without a word don't count, so null, empty and blank texts have none. A notice is a family in a paragraph. Rows that repeat a doc_id get each the findings of their own text;
    null ids are kept. A text of any length is searched whole. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = licence_paragraphs(docs, model, overlap)
    found = cut(found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("f")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "n", "f"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    n_paragraphs = F.when(F.length(trimmed) > 0, F.regexp_count(trimmed, F.lit(BLANK)) + 1).otherwise(0)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), n_paragraphs.cast("long").alias("n_paragraphs"))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["text_key"] == found["k"]), "left")
    return rows.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("f", F.lit("")).alias("families"))
