"""License scans: a paragraph classifier over word n-grams, an unknown class, and template comparison."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import batches_by_bytes, only
from tidelog.llm.decontam import PUNCTUATION
from tidelog.llm.linear import fit_logistic

# Notices of licence families, as their users write them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "gpl-2.0": ("Licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    "lgpl": ("Licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    "agpl-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc0": ("Released into the public domain under CC0 1.0.", "This work is dedicated to the public domain."),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
}
# Sentences about terms that name no family above; what is like them is of unknown family.
UNKNOWN = (
    "Licensed under the terms of the agreement with the vendor.",
    "This work is licensed under a custom license.",
    "Released under the company license, version 1.",
    "The license of this file is described in another document.",
    "Use is permitted under the license that came with the product.",
    "You may redistribute this text under the terms of its license.",
)
# Plain sentences that share words with notices.
PLAIN = (
    "The general public was free to visit the version on show.",
    "The work is under way and all of it is for the public.",
    "They were released under the bridge in the morning.",
    "This is the work of the first foundation of the city.",
    "No part of the house may be seen from the road.",
    "She has the right to use the software of the office.",
)
FAMILIES = (*TEMPLATES, "unknown", "none")
_DROP = str.maketrans("", "", PUNCTUATION.decode())


def words_of(paragraph: str) -> list[str]:
    return paragraph.lower().translate(_DROP).split()


@dataclass
class Model:
    """Vocabulary and weights of word 1- and 2-grams for each family, a temperature, and the floor of known families."""

    vocabulary: dict[str, int]
    single: np.ndarray  # word, family
    pairs: np.ndarray  # sorted codes of word pairs
    double: np.ndarray  # pair, family
    bias: np.ndarray
    temperature: float
    floor: float

    def chances(self, ids: np.ndarray, paragraph: np.ndarray, count: int) -> np.ndarray:
        """(paragraph, family) chances; ids are words (-1: not in the vocabulary) and paragraph says whose."""
        known = np.flatnonzero(ids >= 0)
        n = np.maximum(np.bincount(paragraph, minlength=count), 1)
        code = ids[:-1] * len(self.vocabulary) + ids[1:]
        two = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (paragraph[:-1] == paragraph[1:])) if len(ids) > 1 else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.pairs, code[two]), len(self.pairs) - 1)
        hit = self.pairs[at] == code[two]
        two, at = two[hit], at[hit]
        margin = np.empty((count, len(FAMILIES)))
        for f in range(len(FAMILIES)):
            sums = np.bincount(paragraph[known], weights=self.single[ids[known], f], minlength=count) + np.bincount(paragraph[two], weights=self.double[at, f], minlength=count)
            margin[:, f] = sums / np.sqrt(n) + self.bias[f]
        margin = margin / self.temperature
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def examples(plain: list[str], seed: int = 11, each: int = 60) -> list[tuple[list[str], int]]:
    """Training paragraphs: notices with words lost and others' words around them; half as many without any notice."""
    rng, out = random.Random(seed), []
    pool = [w for p in plain for w in words_of(p)] or ["text"]
    noise = lambda k: [rng.choice(pool) for _ in range(rng.randrange(k + 1))]
    for f, name in enumerate(FAMILIES[:-1]):
        for text in TEMPLATES.get(name, UNKNOWN):
            w = words_of(text)
            for k in range(each):
                body = [x for x in w if k == 0 or rng.random() > 0.08]
                out.append((noise(6 if k % 2 else 0) + body + noise(6 if k % 3 == 0 else 0), f))
    none = len(FAMILIES) - 1
    for text in (*PLAIN, *plain):
        out.append((words_of(text), none))
    salad = sorted({w for p in PLAIN for w in words_of(p)} | {w for own in TEMPLATES.values() for text in own for w in words_of(text) if len(w) <= 4})
    for k in range(each * 30):
        mixed = [rng.choice(salad) for _ in range(rng.randrange(1, 16))] + noise(20 if k % 2 else 0)
        rng.shuffle(mixed)
        out.append((mixed, none))
    return out


def train(plain: list[str], seed: int = 11) -> Model:
    """A model from the templates and a bounded list of plain paragraphs.

    One logistic regression a family over 1- and 2-gram counts divided by the root of the word count; the temperature
    is the one of a few that gives a held-out fifth the best likelihood, and the floor is the least chance that keeps
    19 of 20 held-out notices of known families.
    """
    rows = examples(plain, seed)
    vocabulary: dict[str, int] = {}
    for name in TEMPLATES:
        for text in TEMPLATES[name]:
            for w in words_of(text):
                vocabulary.setdefault(w, len(vocabulary))
    for text in (*UNKNOWN, *PLAIN):
        for w in words_of(text):
            vocabulary.setdefault(w, len(vocabulary))
    v = len(vocabulary)
    codes = sorted({vocabulary[a] * v + vocabulary[b] for w, _ in rows for a, b in zip(w, w[1:], strict=False) if a in vocabulary and b in vocabulary})
    pairs = np.array(codes or [-1], np.int64)
    r, c, x = [], [], []
    for k, (w, _) in enumerate(rows):
        ids = [vocabulary.get(t, -1) for t in w]
        weight = 1 / np.sqrt(max(1, len(w)))
        for i in ids:
            if i >= 0:
                r.append(k), c.append(i), x.append(weight)
        for a, b in zip(ids, ids[1:], strict=False):
            if a >= 0 and b >= 0:
                r.append(k), c.append(v + int(np.searchsorted(pairs, a * v + b))), x.append(weight)
    r, c, x, y = np.array(r), np.array(c), np.array(x), np.array([f for _, f in rows])
    test = np.arange(len(rows)) % 5 == 4
    keep = ~test[r]
    place = np.cumsum(~test) - 1
    single, double, bias = np.zeros((v, len(FAMILIES))), np.zeros((len(pairs), len(FAMILIES))), np.zeros(len(FAMILIES))
    for f in range(len(FAMILIES)):
        w, bias[f] = fit_logistic(place[r[keep]], c[keep], x[keep], (y[~test] == f).astype(float), v + len(pairs), 1e-4, 250, 0.2)
        single[:, f], double[:, f] = w[:v], w[v:]
    model = Model(vocabulary, single, pairs, double, bias, 1.0, 0.0)
    ids = np.array([vocabulary.get(t, -1) for k in np.flatnonzero(test) for t in rows[k][0]], np.int64)
    who = np.repeat(np.arange(test.sum()), [len(rows[k][0]) for k in np.flatnonzero(test)])
    best = -np.inf
    for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        model.temperature = t
        p = model.chances(ids, who, int(test.sum()))[np.arange(test.sum()), y[test]]
        if (score := float(np.log(p + 1e-12).mean())) > best:
            best, chosen = score, t
    model.temperature = chosen
    p = model.chances(ids, who, int(test.sum()))
    known = y[test] < len(FAMILIES) - 2
    model.floor = float(np.quantile(p[known, y[test][known]], 0.05)) if known.any() else 0.5
    return model


def similarity(words: list[str], family: str) -> tuple[float, int]:
    """The best share of a template's word pairs that a paragraph has, over the family's templates, and which it is."""
    have, best = set(zip(words, words[1:], strict=False)), (0.0, -1)
    for k, text in enumerate(TEMPLATES.get(family, ())):
        w = words_of(text)
        want = set(zip(w, w[1:], strict=False))
        best = max(best, (len(want & have) / len(want), -k - 1)) if want else best
    return best[0], -best[1] - 1 if best[1] < 0 and best[0] > 0 else -1


_PAIRS = {pair for text in (*(t for own in TEMPLATES.values() for t in own), *UNKNOWN) for pair in zip(words_of(text), words_of(text)[1:], strict=False)}


def shared_pairs(paragraph: str) -> int:
    """Distinct word pairs that a paragraph shares with any notice or sentence about terms."""
    words = words_of(paragraph)
    return len(_PAIRS & set(zip(words, words[1:], strict=False)))


#: Share of a line's word pairs that notices have, from which it may be a part of a wrapped one.
ALIKE = 0.5


def wrapped(alike: np.ndarray, document: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind last) of the runs of two or more neighbouring lines of a document that are alike."""
    joined = alike[1:] & alike[:-1] & (document[1:] == document[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
    return [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def plain_lines(texts: DataFrame, most: int, longest: int = 4000) -> list[str]:
    """One line each of at most `most` documents, chosen by hash, without lines that speak of licences or are longer than
    `longest` characters."""
    hashed = texts.where("text is not null and text != ''").withColumn("h", F.xxhash64("id", "text"))
    first = [r["h"] for r in hashed.select("h").orderBy("h").limit(most).collect()]
    if not first:
        return []
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x).between(1, longest) & ~F.lower(x).rlike("licen|rights|public domain"))
    some = hashed.where(F.col("h") <= first[-1]).select("h", lines.alias("l")).where("size(l) > 0").selectExpr("h", "l[cast(pmod(h, size(l)) as int)] as line").distinct()
    return [r["line"] for r in some.orderBy("h", "line").limit(most).collect()]


def scan(docs: DataFrame, confirm: float = 0.8, max_plain: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, lines, family, probability, similarity, template, confirmed) for each paragraph that holds a notice.

    A paragraph is a line, or a run of neighbouring lines half of whose word pairs notices have, as wrapped notices are;
    punctuation is no part of words, so comment signs drop out and a line of them alone ends a run. Lines of whole texts
    are numbered from 0; a run has its first line's number. A line whose likeliest class is none, or that shares fewer
    than two word pairs with any notice, is not listed; one whose family is below the floor, or that does not have
    `confirm` of a template's word pairs, is listed as of family unknown, unconfirmed. A run is listed if it is confirmed,
    in place of its lines that are unconfirmed or of the same family. At most max_plain documents,
    chosen by hash, lend a line of theirs to the class none. Null and empty texts have no paragraphs; null ids and
    repeated rows are scanned each; long texts are scanned whole; equal chances go to the first family; other columns
    are not read; an empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = only(docs, id_col, text_col).toDF("id", "text")
    shared = spark.sparkContext.broadcast(train(plain_lines(texts, max_plain)))
    none, unknown = len(FAMILIES) - 1, len(FAMILIES) - 2

    def parsed(lines: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (-1: not in the vocabulary) of lines, and whose each is."""
        mark = "\x00"
        flat = f" {mark} ".join([line.replace(mark, " ") for line in lines]).lower().translate(_DROP).split()
        ids = np.fromiter(map(model.vocabulary.get, flat, repeat(-1)), np.int64, len(flat))
        ends = np.fromiter((w == mark for w in flat), bool, len(flat))
        return ids[~ends], np.cumsum(ends)[~ends]

    def judged(model: Model, chances: np.ndarray, text: str) -> tuple[int, float, int, bool]:
        f = int(chances.argmax())
        got, which = similarity(words_of(text), FAMILIES[f]) if f != none else (0.0, -1)
        return f, got, which, f not in (none, unknown) and chances[f] >= model.floor and got >= confirm

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, size = shared.value, len(shared.value.vocabulary)
        notice = np.array(sorted(model.vocabulary[a] * size + model.vocabulary[b] for a, b in _PAIRS), np.int64)
        for pdf in batches_by_bytes(batches, "text"):
            lines = [(d, k, line) for d, t in enumerate(pdf["text"]) if isinstance(t, str) for k, line in enumerate(t.split("\n"))]
            ids, who = parsed([x[2] for x in lines], model) if lines else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if not len(ids):
                continue
            own = pdf["id"].tolist()
            p, out, sure = model.chances(ids, who, len(lines)), [], {}
            for k in np.flatnonzero(p.argmax(axis=1) != none).tolist():
                f, got, which, good = judged(model, p[k], lines[k][2])
                if (f == unknown or got < confirm) and shared_pairs(lines[k][2]) < 2:
                    continue
                sure[k] = f if good else -1
                out.append((k, 1, FAMILIES[f] if good else "unknown", float(p[k, f]), got, f"{FAMILIES[f]}/{which}" if good else None, good))
            pair = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (who[:-1] == who[1:]))
            code = ids[pair] * size + ids[pair + 1]
            code = notice[np.minimum(np.searchsorted(notice, code), len(notice) - 1)] == code
            words, pairs = np.bincount(who, minlength=len(lines)), np.bincount(who[pair[code]], minlength=len(lines))
            alike = np.where(words > 1, pairs >= np.maximum(1, ALIKE * (words - 1)), np.bincount(who[ids >= 0], minlength=len(lines)) > 0)
            spans = wrapped(alike, np.array([x[0] for x in lines]))
            if spans:
                joined = [" ".join(x[2] for x in lines[a:b]) for a, b in spans]
                q = model.chances(*parsed(joined, model), len(joined))
                for (a, b), text, chances in zip(spans, joined, q, strict=True):
                    f, got, which, good = judged(model, chances, text)
                    if good:
                        out = [x for x in out if not a <= x[0] < b or x[1] > 1 or sure[x[0]] not in (-1, f)]
                        out.append((a, b - a, FAMILIES[f], float(chances[f]), got, f"{FAMILIES[f]}/{which}", True))
            if out:
                rows = [(own[lines[k][0]], lines[k][1], *rest) for k, *rest in sorted(out, key=lambda x: x[:3])]
                yield pd.DataFrame(rows, columns=["id", "paragraph", "lines", "family", "probability", "similarity", "template", "confirmed"]).astype({"id": pdf["id"].dtype})

    return texts.mapInPandas(run, f"id {kind}, paragraph int, lines int, family string, probability double, similarity double, template string, confirmed boolean")
