"""Repeated steps: levels against all windows, and candidates of an estate."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import extract, questions
from flowloom.sources import estate


def by_hand(containers, min_length, min_occurrences):
    """All windows; the longest first, kept if one occurrence is in no kept one."""
    found = {}
    for c, sigs in containers.items():
        for a in range(len(sigs)):
            for b in range(a + 1, len(sigs) + 1):
                if sigs[b - 1] is None:
                    break
                if b - a >= min_length:
                    found.setdefault(tuple(sigs[a:b]), []).append((c, a))
    often = {k: v for k, v in found.items() if len(v) >= min_occurrences}
    kept = []
    for sigs in sorted(often, key=lambda k: (-len(k), k)):
        if not all(any(c == d and a <= s and s + len(sigs) <= a + len(k) for k in kept for d, a in often[k]) for c, s in often[sigs]):
            kept.append(sigs)
    return often, set(kept)


@pytest.mark.parametrize("seed, min_length, min_occurrences", [(1, 1, 2), (2, 2, 2), (3, 2, 3), (4, 3, 2)])
def test_levels_equal_all_windows(spark, seed, min_length, min_occurrences):
    dice = random.Random(seed)
    containers = {c: [dice.choice(["a", "b", "c", "a", None]) for _ in range(dice.randint(0, 12))] for c in range(12)}
    steps = spark.createDataFrame([(c, k, s) for c, sigs in containers.items() for k, s in enumerate(sigs)], "container long, ord int, sig string").repartition(3)
    sequences, sites = extract.grown(steps, min_length, min_occurrences)
    often, kept = by_hand(containers, min_length, min_occurrences)
    got = extract.spelled(sequences, steps).collect()
    assert {tuple(r["sigs"]): (r["length"], r["occurrences"], tuple(r["id"])) for r in got} == {k: (len(k), len(v), min(v)) for k, v in often.items()} and len(got) == len(often)
    assert {tuple(r["sigs"]) for r in got if r["kept"]} == kept
    cited = {(tuple(r["id"]), r["length"], r["container"], r["start"]) for r in sites.collect()}
    assert cited == {(min(v), len(k), *place) for k, v in often.items() for place in v}


@pytest.mark.parametrize("seed, min_length, ahead, chunk", [(5, 1, 1, 4096), (6, 2, 2, 2), (7, 2, 3, 5), (8, 3, 2, 1)])
def test_runs_counted_at_once_go_on_in_levels(spark, monkeypatch, seed, min_length, ahead, chunk):
    monkeypatch.setattr(extract, "CHUNK", chunk)
    dice = random.Random(seed)
    containers = {c: [dice.choice(["a", "b", "a", "a", None]) for _ in range(dice.randint(0, 14))] for c in range(9)}
    steps = spark.createDataFrame([(c, k, s) for c, sigs in containers.items() for k, s in enumerate(sigs)], "container long, ord int, sig string").repartition(3)
    sequences, sites = extract.grown(steps, min_length, 2, ahead)
    often, kept = by_hand(containers, min_length, 2)
    got = extract.spelled(sequences, steps).collect()
    assert {tuple(r["sigs"]): (r["occurrences"], tuple(r["id"])) for r in got} == {k: (len(v), min(v)) for k, v in often.items()} and len(got) == len(often)
    assert {tuple(r["sigs"]) for r in got if r["kept"]} == kept
    cited = [(tuple(r["id"]), r["length"], r["container"], r["start"]) for r in sites.collect()]
    assert sorted(cited) == sorted((min(v), len(k), *place) for k, v in often.items() for place in v)


def test_short_containers_take_no_level(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(extract, "cut", lambda df, cut=extract.cut: cuts.append(df.columns) or cut(df))
    steps = spark.range(21).select((F.col("id") % 3).alias("container"), F.expr("cast(id div 3 as int)").alias("ord"), F.lit("a").alias("sig"))
    sequences, _ = extract.grown(steps, 2, 3)
    assert {(r["length"], r["occurrences"], r["kept"]) for r in sequences.collect()} == {(n, 3 * (8 - n), n == 7) for n in range(2, 8)}
    assert len(cuts) <= 4 and not any("place" in c for c in cuts)  # a cut a level, of all places, before


def test_a_container_of_very_many_steps(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("container"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("s"), F.col("id") % 49_999).alias("sig"))
    sequences, _ = extract.grown(rows.where("ord < 50002"), 2, 2)
    assert [(tuple(r["id"]), r["length"], r["occurrences"]) for r in sequences.where("kept").collect()] == [((1, 0), 3, 2)]


@pytest.mark.parametrize("asked", [(0, 2), (2, 1)])
def test_nothing_asked_for(spark, asked):
    steps = spark.createDataFrame([(1, 0, "a"), (1, 1, "a")], "container long, ord int, sig string")
    assert extract.grown(steps, *asked)[0].count() == 0


def test_meaningful_lines(spark):
    texts = ["#!/bin/sh\nset -e\n\tset -euo pipefail\n \n\tmake all ", "set -x\nmake", "set -eo pipefail", "set -e -u\nx", None, "", "set -eux\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    got = {r["k"]: r["l"] for r in df.select("k", extract.first_meaningful_line(F.col("t")).alias("l")).collect()}
    assert [got[k] for k in range(len(texts))] == ["make all", "set -x", None, "set -e -u", None, None, "set -eux"]


def test_candidates_of_an_estate(spark, tmp_path):
    boot = "      - uses: actions/checkout@v4\n        with: {depth: 1}\n      - uses: ./tools/setup\n      - run: |\n          set -e\n          npm ci\n          npm test\n      - uses: docker://node:20\n"
    for k, extra in enumerate(["      - run: echo a\n", "", "      - run: echo b\n"]):
        path = tmp_path / f".github/workflows/w{k}.yml"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"on: push\njobs:\n  j:\n    runs-on: x\n    steps:\n{extra}{boot}")
    (tmp_path / "tools/setup").mkdir(parents=True)
    (tmp_path / "tools/setup/action.yml").write_text("runs:\n  using: composite\n  steps:\n    - run: npm ci\n      shell: sh\n    - uses: docker://node:20\n")
    candidates, sites = questions.extraction(estate.load(spark, str(tmp_path)), 2, 2)
    rows = candidates.orderBy("rank").collect()
    assert [(r["rank"], r["length"], r["occurrences"], r["score"]) for r in rows] == [(1, 4, 3, 8), (2, 2, 4, 6)]
    flow = ".github/workflows/w{}.yml:j"
    assert sorted((r["container"], r["start"], r["end"]) for r in sites.where("length = 4").collect()) == [(flow.format(0), 1, 5), (flow.format(1), 0, 4), (flow.format(2), 1, 5)]
    assert ("tools/setup:_composite", 0, 2) in {(r["container"], r["start"], r["end"]) for r in sites.where("length = 2").collect()}
    assert rows[0]["sketch"] == questions.SKETCH + (
        "    - uses: actions/checkout@v4\n      # TODO: parametrize via inputs:\n    - uses: ./tools/setup\n    - shell: bash\n      run: |\n        set -e\n        npm ci\n        npm test\n    - uses: docker://node:20\n"
    )
