import random

import numpy as np
import pytest

from flowloom.llm import licences


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_held_out_forms_of_the_templates(model):
    labelled = licences.examples(["plain words of no interest at all", "the river under the stone bridge"], seed=99, copies=6)
    found = model.probabilities([w for w, _ in labelled])
    right = np.mean([p.argmax() == c for p, (_, c) in zip(found, labelled)])
    assert right > 0.95
    sure = found.max(axis=1)
    assert abs(sure.mean() - right) < 0.06  # calibrated


def test_given_notices_are_found_where_they_are(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    notices = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in licences.scan(docs, model).collect():
        want = sorted({f for n, f in notices.items() if n in texts[r["doc_id"]].split("\n")})
        assert r["families"] == want, r


def test_unknown_notices_and_decoys(model):
    chance = random.Random(0)
    for text in licences.OTHERS:
        assert all(not ok for *_, ok in licences.scan_text(text, model)[1])
    for text in licences.DECOYS:
        assert licences.scan_text(text, model)[1] == []
    long_ = " ".join(chance.choice(["river", "stone"]) for _ in range(300))
    assert [h[1] for h in licences.scan_text(f"{long_} Released under the MIT License. {long_}", model)[1] if h[3]] == ["MIT"]


def test_odd_rows(odd, empty, model):
    assert licences.scan(odd, model).count() == odd.count() and licences.scan(empty, model).count() == 0
    rows = licences.scan(odd, model).collect()
    assert all(r["n_confirmed"] == 0 for r in rows)
    licences.train(empty)


def confirmed(text, model):
    return sorted({name for _, name, _, ok in licences.scan_text(text, model)[1] if ok})


GNU = """This {} is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version."""
BSD = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
CLAUSE = """
3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


@pytest.mark.parametrize(
    "text, want",
    [
        (GNU.format("program", "", 3), ["GPL-3.0"]),
        (GNU.format("program", "", 2), ["GPL-2.0"]),
        (GNU.format("library", "Lesser ", 3), ["LGPL-3.0"]),
        (GNU.format("program", "Affero ", 3), ["AGPL-3.0"]),
        (BSD, ["BSD-2-Clause"]),
        (BSD + CLAUSE, ["BSD-3-Clause"]),
        (ISC, ["ISC"]),
        ("// SPDX-License-Identifier: MIT", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-3.0-or-later OR Apache-2.0\nimport os", ["Apache-2.0", "GPL-3.0"]),
        ("Licensed under the MIT License, or licensed under the Apache License, Version 2.0, at your option.", ["Apache-2.0", "MIT"]),
        ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", ["LGPL-3.0"]),
    ],
)
@pytest.mark.parametrize("around", ["", "river and stone under the bridge " * 9])
def test_standard_notices(model, text, want, around):
    assert confirmed(f"{around}\n{text}\n{around}", model) == want


def test_templates_confirm_their_own_family_alone():
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            assert list(licences.confirmed_in(licences.words_of(t))) == [family], t


def test_notices_of_no_family_are_unknown():
    """Licences that have no template, and bodies cut in lines, get no family that they don't resemble."""
    plain = [f"the river {k} runs past the old stone bridge and the garden wall in the morning light" for k in range(60)]
    model = licences.fit(licences.examples(plain))
    wtfpl = "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."
    assert {n for _, n, _, _ in licences.scan_text(wtfpl, model)[1]} <= {"unknown"}
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    found = licences.scan_text(mit, model)[1]
    assert ("MIT", True) in {(n, sure) for _, n, _, sure in found} and {n for _, n, _, _ in found} <= {"MIT", "unknown"}
    body = "Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation\nand/or other materials provided with the distribution."
    assert {n for _, n, _, _ in licences.scan_text(body, model)[1]} <= {"BSD-2-Clause", "BSD-3-Clause", "unknown"}


def test_notices_of_families_left_out_are_unknown(spark):
    """The threshold, set on other splits and forms, parts known families from those that a model hasn't seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(200)
    plain = [(r["text"] or "")[:400] for r in docs.collect()]
    least = licences.unknown_threshold(licences.examples(plain, seed=6, copies=8))
    out = {licences.CLASSES.index(n) for n in ("Apache-2.0", "CC-BY-NC-4.0", "CC0-1.0", "ISC", "MIT", "MPL-2.0")}
    known, strange = licences.left_out(licences.examples(plain, seed=11, copies=8), out)
    first = licences.THRESHOLDS[0]
    assert least > first and (known >= least).mean() > 0.8 and (strange < least).mean() > max(0.8, (strange < first).mean())


@pytest.mark.parametrize(
    "text",
    [
        "Licensed under the Apache License, Version 1.1.",
        "Licensed under the Mozilla Public License, version 1.1.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License).",
        "MIT No Attribution License (MIT-0)",
        "Released under the MIT No Attribution License (MIT-0).",
        "This is not licensed under the MIT License.",
        "It is no longer released under the ISC License.",
        "Licensed under the GNU Lesser General Public License v2.1.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use it. Boost Software License.",
    ],
)
def test_other_versions_rivals_and_denials(model, text):
    found = licences.scan_text(text, model)[1]
    assert found and all(name == "unknown" and not ok for _, name, _, ok in found), found


def test_versions_are_those_behind_the_name(model):
    assert confirmed("Licensed under the Apache License, Version 2.0. The Mozilla Public License, version 1.1 is another one.", model) == ["Apache-2.0"]
    assert confirmed("Licensed under the Mozilla Public License, version 2.0. See Apache 1.1.", model) == ["MPL-2.0"]
    assert confirmed("You may not use this otherwise than as said below in full. Released under the ISC License.", model) == ["ISC"]


def test_versions_said():
    said = lambda text, family: licences.version_said(licences.words_of(text), family)
    assert said("GNU General Public License, version 3.", "GPL-3.0") is True and said("GNU General Public License, version 3.", "GPL-2.0") is False
    assert said("the GNU General Public License", "GPL-2.0") is None and said("GNU Lesser General Public License v3", "GPL-3.0") is None
    assert said("Apache License 1.1 or Apache License 2.0", "Apache-2.0") is True and said("Mozilla Public License, v. 2.0", "MPL-2.0") is True
    assert said("GNU Lesser General Public License v2.1", "LGPL-3.0") is False and said("MIT License", "MIT") is None


def plainly_confirmed(text):
    """Families by templates, from the definition: parts of 60 words, one by one, each template's triples counted."""
    words, out = licences.words_of(text), set()
    for at in range(0, max(1, len(words) - 30), 30):
        part = words[at : at + 60]
        have = [tuple(part[k : k + 3]) for k in range(len(part) - 2)]
        said = " " + " ".join(part) + " "
        for family, templates in licences.TEMPLATES.items():
            shares = []
            for template in templates:
                own = licences.words_of(template)
                triples = {tuple(own[k : k + 3]) for k in range(len(own) - 2)}
                shares.append((sum(t in have for t in triples) / len(triples), -len(shares), triples))
            share, _, triples = max(shares, key=lambda s: s[:2])
            marked = all(any(f" {m} " in said for m in group) for group in licences.MARKS.get(family, ()))
            if share >= licences.MIN_CONTAINED and marked and not licences.contradicted(part, family) and (family not in licences.VERSIONS or licences.version_said(part, family)):
                begin = min(k for k, t in enumerate(have) if t in triples)
                if not set(part[max(0, begin - 2) : begin]) & licences.DENIALS:
                    out.add(family)
    return out


def test_templates_as_counted_one_by_one():
    chance = random.Random(8)
    filler = "river stone under the license not of version 2.0 public and".split()
    every = [t for texts in licences.TEMPLATES.values() for t in texts] + licences.OTHERS
    for _ in range(150):
        text = " ".join(" ".join(licences.altered(licences.words_of(chance.choice(every)), filler, chance)) for _ in range(chance.randint(1, 4)))
        words = licences.words_of(text)
        got = {f for _, w in licences.windows_of(words) for f in licences.confirmed_in(w)}
        assert got == plainly_confirmed(text), text
