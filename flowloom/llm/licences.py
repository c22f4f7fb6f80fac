"""Licence scans by a trained paragraph classifier.

A softmax regression over hashed word n-grams (one to three words) names the licence
family of a paragraph, or none. It is trained on the templates below in altered forms
(words dropped, put in, cased and cut differently) and on paragraphs of the corpus that
resemble no template. Its probabilities are calibrated on held-out examples by a
temperature. From which probability on a family counts is set on families left out of
training: models that haven't seen a third of the families must take their notices for
unknown. A paragraph that speaks of licences but gets no family with that probability, or
one of whose templates it holds next to nothing, is of the unknown class. Every family counts as confirmed of which a window holds enough
of the word triples of one template, in any order, and the words that tell it from its
siblings, or which an SPDX identifier names, unless the window denies it, doesn't name its version
or holds words of a rival with a like text; the classifier judges the rest, under the same conditions.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import features

BITS = 15
MAX_NEGATIVES = 2_000  # corpus paragraphs that training reads, the only bound here
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98)  # that the probability of a family is held against
FOLDS = 3  # of the families left out in turn
KEPT = 0.9
MIN_CONTAINED = 0.6
MIN_SUPPORT = 0.2  # of a template's word triples that a window must hold for the classifier's family to count at all
WINDOW = 60  # words; longer paragraphs are read in overlapping windows

# Short public licence notices by family.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Use of this source code is governed by a BSD 2-Clause license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "The MIT License (MIT)"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
# Further paragraphs of these licences, which don't name a family for sure.
BODIES = {
    "BSD-2-Clause": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "MIT": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
}
# Words that tell a family from those of like templates; one of each group is needed.
MARKS = {
    "AGPL-3.0": (("affero",),),
    "Apache-2.0": (("apache",),),
    "BSD-2-Clause": (("bsd 2 clause", "redistribution and use"),),
    "BSD-3-Clause": (("bsd 3 clause", "bsd style", "neither the name"),),
    "CC-BY-4.0": (("cc by 4.0", "attribution 4.0"),),
    "CC-BY-NC-4.0": (("cc by nc 4.0", "attribution noncommercial 4.0"),),
    "CC-BY-SA-4.0": (("cc by sa 4.0", "attribution sharealike 4.0"),),
    "GPL-2.0": (("gnu general",),),
    "GPL-3.0": (("gnu general",),),
    "ISC": (("isc license", "with or without fee is hereby granted"),),
    "LGPL-3.0": (("lesser",),),
    "MIT": (("mit", "hereby granted free"),),
    "MPL-2.0": (("mozilla",),),
    "Unlicense": (("unlicense", "free and unencumbered"),),
}
# The name after which a family's version stands, and that version.
VERSIONS = {
    "AGPL-3.0": ("affero general public license", "3"),
    "Apache-2.0": ("apache license", "2"),
    "GPL-2.0": ("gnu general public license", "2"),
    "GPL-3.0": ("gnu general public license", "3"),
    "LGPL-3.0": ("lesser general public license", "3"),
    "MPL-2.0": ("mozilla public license", "2"),
}
VERSION_WORDS = 14  # behind the name, in which the version stands
# Words of other licences with a like text, and of those that say no to a notice.
RIVALS = {
    "BSD-2-Clause": ("bsd 4 clause", "all advertising materials", "bsd 1 clause"),
    "BSD-3-Clause": ("bsd 4 clause", "all advertising materials"),
    "ISC": ("zero clause", "0bsd"),
    "MIT": ("mit no attribution", "mit 0", "boost software", "person or organization obtaining"),
}
DENIALS = frozenset("not isn never longer neither nor".split())
# What every paragraph about licences holds one of, lower case.
ANCHORS = ("licen", "copyright", "permission", "public domain", "warrant", "redistribut", "spdx", "governed by", "distributed under")
# Sentences that hold such words and are no licences.
DECOYS = [
    "He renewed his driver's license before the journey.",
    "You need permission from the teacher to leave the room.",
    "The police issued a warrant for the arrest of the suspect.",
    "A dog license costs ten dollars in this county.",
    "The restaurant lost its license to serve wine.",
    "Copyright law was reformed in the last century.",
    "All rights reserved, copyright by the publisher.",
    "This statement is in the public domain of discourse.",
]
#: Notices of no family above: the classifier must leave them to the unknown class.
OTHERS = ["This file may be copied under the terms of our own software license.", "Use is subject to license terms.", "Licensed to the customer under a commercial agreement.", "All use requires a license from the company.", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "You just do what you want to, under the terms of this public license.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."]
CLASSES = ["none", "unknown", *TEMPLATES]

_blank = re.compile(r"\n[^\S\n]*\n")
_spdx = re.compile(r"spdx-license-identifier\s*:([^\n]*)", re.I)
_spdx_ids = {f.lower(): f for f in TEMPLATES}
_spdx_form = re.compile(r"(?:-only|-or-later|\+)$")
_word = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def triples_of(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)}


_triples = {family: [triples_of(words_of(t)) for t in texts] for family, texts in TEMPLATES.items()}


_support = {family: [*own, *(triples_of(words_of(t)) for t in BODIES.get(family, ()))] for family, own in _triples.items()}


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word n-grams of a window; each counts once, all together have length one."""
    grams = {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}
    numbers = np.unique(np.fromiter((xxhash.xxh32_intdigest(g) & ((1 << BITS) - 1) for g in grams), np.int64, len(grams)))
    return numbers, np.full(len(numbers), 4 / np.sqrt(max(1, len(numbers))))


def contained(words: list[str], family: str) -> float:
    """The largest part of the word triples of a family's template or body that is in a window."""
    have = triples_of(words)
    return max(len(t & have) / len(t) for t in _support[family])


def spdx_of(text: str) -> set[str]:
    """The families that SPDX identifiers name."""
    names = {_spdx_form.sub("", n) for line in _spdx.findall(text) for n in re.findall(r"[a-z0-9.+-]+", line.lower())}
    return {_spdx_ids[n] for n in names if n in _spdx_ids}


_number = re.compile(r"v?(\d+)(?:\.(\d+))*")


def version_said(words: list[str], family: str) -> bool | None:
    """If the first number behind some place of the family's name is its version; None if no number is there, or it has no versions."""
    if family not in VERSIONS:
        return None
    name, version = VERSIONS[family]
    own, k = name.split(), len(name.split())
    met = [next((m for w in words[at + k : at + k + VERSION_WORDS] if (m := _number.fullmatch(w))), None) for at in range(len(words) - k + 1) if words[at : at + k] == own]
    return any(m[1] == version and int(m[2] or 0) == 0 for m in met if m) if any(met) else None


def contradicted(words: list[str], family: str) -> bool:
    """If a window speaks of another licence with a like text, or of another version only."""
    said = f" {' '.join(words)} "
    return any(f" {r} " in said for r in RIVALS.get(family, ())) or version_said(words, family) is False


def denied(words: list[str], at: int) -> bool:
    """If what begins at a place of a window is denied right before it."""
    return bool(DENIALS & set(words[max(0, at - 2) : at]))


def denied_notice(words: list[str]) -> bool:
    """If a window says that something isn't under a licence."""
    return any(w in ("licensed", "released", "distributed", "available", "covered") and denied(words, k) for k, w in enumerate(words))


def confirmed_in(words: list[str]) -> dict[str, tuple[int, int]]:
    """Each family that a window confirms, with where the triples of its template begin and end."""
    places: dict[tuple[str, ...], list[int]] = {}
    for k in range(len(words) - 2):
        places.setdefault(tuple(words[k : k + 3]), []).append(k)
    said, found = f" {' '.join(words)} ", {}
    for family, templates in _triples.items():
        best = max(templates, key=lambda t: len(t & places.keys()) / len(t))
        if len(best & places.keys()) >= MIN_CONTAINED * len(best) and all(any(f" {m} " in said for m in group) for group in MARKS.get(family, ())):
            at = [k for t in best & places.keys() for k in places[t]]
            named = family not in VERSIONS or version_said(words, family)
            if named and not contradicted(words, family) and not denied(words, min(at)):
                found[family] = (min(at), max(at) + 3)
    return found


class LicenceModel(NamedTuple):
    weights: np.ndarray  # by feature and class
    constants: np.ndarray
    temperature: float
    threshold: float = THRESHOLDS[0]

    def probabilities(self, windows: list[list[str]]) -> np.ndarray:
        logits = np.array([self.constants + (self.weights[n] * v[:, None]).sum(axis=0) for n, v in map(ngrams, windows)])
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def altered(words: list[str], filler: list[str], chance: random.Random) -> list[str]:
    """A form of a notice as it may be met: words lost or put in, and text around it."""
    out = [w for w in words if chance.random() > 0.06]
    for _ in range(chance.choice((0, 0, 0, 1, 2))):
        out.insert(chance.randrange(len(out) + 1), chance.choice(filler))
    before, after = ([chance.choice(filler) for _ in range(chance.choice((0, 0, 0, 3, 12)))] for _ in range(2))
    return before + out + after


def examples(negatives: list[str], seed: int = 5, copies: int = 25) -> list[tuple[list[str], int]]:
    """Labelled windows: altered templates, other notices, decoys, and corpus paragraphs."""
    chance, out = random.Random(seed), []
    plain = [words_of(p)[:WINDOW] for p in negatives]
    plain = [w for w in plain if w and max((contained(w, f) for f in TEMPLATES), default=0) < 0.3]
    filler = sorted({w for p in plain for w in p}) or ["text"]
    for label, name in enumerate(CLASSES[2:], 2):
        texts = [*TEMPLATES[name], *BODIES.get(name, ())]
        out += [(words_of(t), label) for t in texts]
        out += [(altered(words_of(t), filler, chance), label) for t in texts for _ in range(copies)]
    out += [(altered(words_of(t), filler, chance), 1) for t in OTHERS for _ in range(copies)]
    out += [(altered(words_of(t), filler, chance), 0) for t in DECOYS for _ in range(copies)]
    out += [(w, 0) for w in plain]
    chance.shuffle(out)
    return out


def fit(labelled: list[tuple[list[str], int]], l2: float = 1e-5, steps: int = 120) -> LicenceModel:
    """Softmax regression on four fifths of the examples; the temperature is set on the rest."""
    size, count = 1 << BITS, len(CLASSES)
    cut = len(labelled) * 4 // 5
    rows, used = features.numbered(features.Rows.of([ngrams(w) for w, _ in labelled[:cut]]))
    y = np.array([label for _, label in labelled[:cut]])
    rare = 1 / np.sqrt(np.maximum(1, np.bincount(y, minlength=count)))
    weight = rare[y] / rare[y].mean()
    lengths = np.diff(rows.starts)
    owner = np.repeat(np.arange(len(y)), lengths)
    filled = np.flatnonzero(lengths)
    by_feature = np.argsort(rows.numbers, kind="stable")
    firsts = np.searchsorted(rows.numbers[by_feature], np.arange(len(used)))
    its_owner, its_value = owner[by_feature], rows.values[by_feature][:, None]

    def gradient(p: np.ndarray) -> np.ndarray:
        w = p.reshape(len(used) + 1, count)
        logits = np.zeros((len(y), count))
        logits[filled] = np.add.reduceat(w[rows.numbers] * rows.values[:, None], rows.starts[filled])
        error = softmax(logits + w[-1])
        error[np.arange(len(y)), y] -= 1
        error *= weight[:, None] / len(y)
        out = np.empty_like(w)
        out[:-1] = np.add.reduceat(its_value * error[its_owner], firsts) + l2 * w[:-1]
        out[-1] = error.sum(axis=0)
        return out.ravel()

    fitted = features.minimise(gradient, (len(used) + 1) * count, steps, rate=0.1).reshape(-1, count)
    p = np.zeros((size + 1, count))
    p[used], p[size] = fitted[:-1], fitted[-1]
    model = LicenceModel(p[:size], p[size], 1.0)
    held = labelled[cut:]
    losses = {t: -np.log(np.maximum(model._replace(temperature=t).probabilities([w for w, _ in held])[np.arange(len(held)), [c for _, c in held]], 1e-12)).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    return model._replace(temperature=min(losses, key=losses.get))


def family_chances(model: LicenceModel, windows: list[list[str]]) -> np.ndarray:
    """For each window the probability of its class, 0 if that is no family."""
    p = model.probabilities(windows) if windows else np.zeros((0, len(CLASSES)))
    return np.where(p.argmax(axis=1) > 1, p.max(axis=1), 0.0)


def left_out(labelled: list[tuple[list[str], int]], out: set[int], steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """How sure a model without the classes ``out`` is of a family: for notices held out of those it knows, and for those of ``out``."""
    seen = [e for e in labelled if e[1] not in out]
    model = fit(seen, steps=steps)
    known = [w for w, c in seen[len(seen) * 4 // 5 :] if c > 1]
    return family_chances(model, known), family_chances(model, [w for w, c in labelled if c in out])


def unknown_threshold(labelled: list[tuple[list[str], int]]) -> float:
    """The highest threshold that leaves at least KEPT of the held-out notices of known families theirs, over FOLDS parts of the families left out."""
    parts = [left_out(labelled, set(range(2 + k, len(CLASSES), FOLDS)))[0] for k in range(FOLDS)]
    known = np.concatenate(parts)
    return max((t for t in THRESHOLDS if len(known) and (known >= t).mean() >= KEPT), default=THRESHOLDS[0])


def train(docs: DataFrame, text_col: str = "text", bound: int = MAX_NEGATIVES) -> LicenceModel:
    """Train on the templates and on at most ``bound`` corpus paragraphs (one drawn from each document, smallest text hashes):
    400 characters from a drawn place of the whole paragraph."""
    text = F.col(text_col).cast("string")
    paragraphs = F.split(text, _blank.pattern)
    drawn = F.get(paragraphs, F.pmod(F.xxhash64(text, F.lit("paragraph")), F.size(paragraphs)).cast("int"))
    each = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("h"), drawn.alias("p"))
    each = each.select("h", F.expr("substring(p, cast(1 + pmod(h, greatest(1, length(p) - 399)) as int), 400)").alias("p"))
    chosen = each.select("h").distinct().orderBy("h").limit(bound)  # hashes alone go to the driver from all tasks
    found = sorted(each.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("p").alias("p")).collect())
    negatives = [r["p"] for r in found if r["p"]]
    return fit(examples(negatives))._replace(threshold=unknown_threshold(examples(negatives[::8], seed=6, copies=8)))


def windows_of(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Overlapping windows and where they begin."""
    for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
        yield at, words[at : at + WINDOW]


def scan_text(text: str | None, model: LicenceModel) -> tuple[int, list[tuple[int, str, float, bool]]]:
    """The number of paragraphs (parts between blank lines) and, for each that speaks of licences and isn't of class none,
    its number, classes, their probabilities, and if a template or SPDX identifier confirms them."""
    paragraphs = [p for p in _blank.split(text or "") if p.strip()]
    low = (text or "").lower()
    if not any(a in low for a in ANCHORS):
        return len(paragraphs), []
    found = []
    for k, paragraph in enumerate(paragraphs):
        if not any(a in paragraph.lower() for a in ANCHORS):
            continue
        lines = [w for w in map(words_of, paragraph.split("\n")) if w]
        windows, at = [], 0
        for line in lines:
            windows += [(at + begin, w) for begin, w in windows_of(line)]
            at += len(line)
        if len(lines) > 1:  # notices wrapped over lines
            windows += windows_of([w for line in lines for w in line])
        windows = [(begin, w) for begin, w in windows if any(a in " ".join(w) for a in ANCHORS)]
        if not windows:
            continue
        judged = model.probabilities([w for _, w in windows])
        best: dict[str, tuple[float, bool]] = {}
        spans = []

        def note(name: str, p: float, sure: bool) -> None:
            if name not in best or (sure, p) > best[name][::-1]:
                best[name] = (float(p), sure)

        for (begin, window), p in zip(windows, judged):
            for name, (first, end) in confirmed_in(window).items():
                note(name, p[CLASSES.index(name)], True)
                spans.append((begin + first, begin + end))
        for name in spdx_of(paragraph):
            note(name, judged[:, CLASSES.index(name)].max(), True)
        spdx = ["spdx", "license", "identifier"]
        for (begin, window), p in zip(windows, judged):
            top = int(p.argmax())
            if top == 0 or any(begin < end and first < begin + len(window) for first, end in spans) or (window[:3] == spdx and spdx_of(paragraph)):
                continue  # no licence, or part of a notice that is confirmed
            known = top > 1 and p[top] >= model.threshold and contained(window, CLASSES[top]) >= MIN_SUPPORT and not contradicted(window, CLASSES[top]) and not denied_notice(window)
            note(CLASSES[top] if known else "unknown", p[top], False)
        found += [(k, name, p, sure) for name, (p, sure) in sorted(best.items())]
    # The 2- and the 3-clause text open alike.
    if "neither the name" in " ".join(low.split()) and any(n == "BSD-3-Clause" and sure for _, n, _, sure in found):
        found = [h for h in found if h[1] != "BSD-2-Clause" or not h[3] or "bsd 2 clause" in " ".join(words_of(paragraphs[h[0]]))]
    return len(paragraphs), found


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_paragraphs, families (confirmed, sorted), n_confirmed, n_unconfirmed, n_unknown (paragraphs),
    hits (paragraph, class, probability, confirmed).

    Null, empty and blank texts have no paragraphs; repeated rows and null ids keep a row
    each; an empty table gives an empty result; other columns are left out. One pass
    without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model._replace(weights=model.weights.astype(np.float32)))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hit = pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = [scan_text(t.as_py(), model) for t in batch.column("text")]
            sure = [sorted({name for _, name, _, ok in hits if ok}) for _, hits in found]
            columns = [
                pa.array([n for n, _ in found], pa.int64()),
                pa.array(sure, pa.list_(pa.string())),
                pa.array([sum(ok for *_, ok in hits) for _, hits in found], pa.int64()),
                pa.array([sum(not ok and name != "unknown" for _, name, _, ok in hits) for _, hits in found], pa.int64()),
                pa.array([sum(name == "unknown" for _, name, *_ in hits) for _, hits in found], pa.int64()),
                pa.array([[{"paragraph": k, "family": name, "probability": p, "confirmed": ok} for k, name, p, ok in hits] for _, hits in found], pa.list_(hit)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_paragraphs", "families", "n_confirmed", "n_unconfirmed", "n_unknown", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_paragraphs long, families array<string>, n_confirmed long, n_unconfirmed long, n_unknown long, hits array<struct<paragraph:bigint,family:string,probability:double,confirmed:boolean>>"
    return source.mapInArrow(run, shape).withColumnRenamed("id", id_col)
