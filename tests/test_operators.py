"""Operators against brute force on small random inputs."""

import random
import re

import numpy as np
import pytest

from flowloom.functions import text
from flowloom.operators import dedup, extract, graph, joins, search, secrets
from flowloom.streaming import refresh
from pyspark.sql import functions as F


def reach(edges, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        n = todo.pop()
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_closures_end_on_cycles(spark, seed):
    chance = random.Random(seed)
    edges = [(chance.randrange(20), chance.randrange(20)) for _ in range(25)]
    df, seeds = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (1,), (99,)], "node long")
    assert {r["node"] for r in graph.closure(df, seeds).collect()} == reach(edges, [0, 1, 99])
    back = reach([(b, a) for a, b in edges], [0, 1, 99])
    assert {r["node"] for r in graph.both_ways(df, seeds).collect()} == reach(edges, [0, 1, 99]) | back


def test_paths_stop_at_cycles_in_order(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("c", "b", 1)], "src string, dst string, ord int")
    roots = spark.createDataFrame([("a",)], "node string")
    rows = graph.paths(edges.withColumn("src", F.ascii("src")).withColumn("dst", F.ascii("dst")), roots.select(F.ascii("node").alias("node"))).orderBy("sort_key").collect()
    assert ["".join(map(chr, r["path"])) + "!" * r["is_cycle"] for r in rows] == ["a", "ac", "acb", "acba!", "ab", "aba!"]


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 52), (52, 51)], "a long, b long")
    found = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert found == {**{k: 0 for k in range(31)}, 50: 50, 51: 50, 52: 50}


@pytest.mark.parametrize("seed", range(3))
def test_maximal_sequences_equal_the_greedy_loop(spark, seed):
    chance = random.Random(seed)
    seqs = {c: [chance.choice(["x", "y", "z", None]) for _ in range(chance.randint(1, 8))] for c in range(12)}
    steps = spark.createDataFrame([(c, k, s) for c, q in seqs.items() for k, s in enumerate(q)], "container long, ord int, sig string")
    found = extract.windows(steps, 2)
    got = {tuple(r["sigs"]) for r in extract.maximal(found, extract.buckets(found, 2)).collect()}
    places = {}
    for c, q in seqs.items():
        for i in range(len(q)):
            for j in range(i + 2, len(q) + 1):
                if None not in q[i:j]:
                    places.setdefault(tuple(q[i:j]), []).append((c, i, j))
    taken, want = [], set()
    for sigs, where in sorted(((s, w) for s, w in places.items() if len(w) >= 2), key=lambda x: -len(x[0])):
        if not all(any(c == d and a <= i and j <= b for d, a, b in taken) for c, i, j in where):
            want.add(sigs)
            taken += where
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_similar_pairs_equal_all_pairs(spark, seed):
    chance = random.Random(seed)
    rows = [(d, k, t) for d in range(40) for k, n in (("trigger", 2), ("job", 3), ("use", 4), ("run", 6)) for t in chance.sample("abcdefg", chance.randint(0, min(n, 6))) if chance.random() < 0.9]
    rows += [(100 + d, k, t) for d, k, t in rows if d < 15 and chance.random() < 0.97]
    features = spark.createDataFrame(rows, "doc long, kind string, token string")
    sets = {}
    for d, k, t in rows:
        sets.setdefault(d, {k: set() for k, _ in dedup.WEIGHTS})[k].add(t)
    f32 = np.float32

    def sim(a, b):
        total = None
        for k, w in dedup.WEIGHTS:
            both, union = len(sets[a][k] & sets[b][k]), len(sets[a][k] | sets[b][k])
            term = f32(w) * f32(both / union if union else 1)
            total = term if total is None else f32(total + term)
        return total

    want = {(a, b) for a in sets for b in sets if a < b and sim(a, b) >= f32(0.8)}
    assert {(r["a"], r["b"]) for r in dedup.similar_pairs(features).collect()} == want and want


def test_ordered_joins_equal_nested_loops(spark):
    chance = random.Random(4)
    rows = [(k, chance.randrange(3), chance.randrange(30)) for k in range(40)]
    nodes = [(k, chance.randrange(3), chance.randrange(30), chance.randrange(2)) for k in range(25)]
    r = spark.createDataFrame(rows, "row long, key long, at long")
    n = spark.createDataFrame(nodes, "node long, key long, at long, rank long")
    got = {x["row"]: x["node"] for x in joins.asof_backward(r, n, "key", "at", "row", "node", F.col("rank"), F.expr("at div 7")).collect()}
    assert got == {k: max(((a, rk, i) for i, q, a, rk in nodes if q == key and a <= at), default=(0, 0, None))[2] for k, key, at in rows}
    got = {x["row"]: x["node"] for x in joins.asof_forward(r, n, "key", "at", "row", "node", F.expr("at div 7")).collect()}
    assert got == {k: min(((a, i) for i, q, a, _ in nodes if q == key and a > at), default=(0, None))[1] for k, key, at in rows}
    ranges = [(key, at, at + chance.randrange(6)) for _, key, at, _ in nodes]
    free = joins.outside_ranges(r, spark.createDataFrame(ranges, "key long, lo long, hi long"), "key", "at", "lo", "hi", 7)
    assert {x["row"] for x in free.collect()} == {k for k, key, at in rows if not any(q == key and lo <= at < hi for q, lo, hi in ranges)}


def test_globs():
    match = lambda glob, s: re.fullmatch(text.glob_to_regex(glob).removeprefix(r"(?ds)\A").removesuffix(r"\z"), s, re.S) is not None
    assert match("**/a.yml", "x/y/a.yml") and match("**/a.yml", "a.yml") and not match("*", "a/b")
    assert match("v[12].?", "v1.") and match("ab+", "abb") and not match("a.c", "abc") and match(r"a\*", "a*") and match("*+", "abc")
    for bad in ("[a", "a\\"):
        with pytest.raises(ValueError):
            text.glob_to_regex(bad)


@pytest.mark.parametrize(
    "modes, lost",
    [
        ([("none", None)], 1), ([("inherit", None)], None), ([("explicit", {"X": "${{ secrets.Y }}"})], None), ([("explicit", {"x": "${{ secrets.Y }}"})], 1),
        ([("explicit", {"OTHER": "v"}), ("inherit", None)], 1), ([("inherit", None), ("none", None)], 2), ([("explicit", {"y": "fixed"}), ("explicit", {"X": "${{ secrets.Y }}"})], None),
        ([("none", None), ("explicit", {"X": "${{ secrets.GITHUB_TOKEN }}"})], None), ([("explicit", {}), ("inherit", None), ("inherit", None)], 1),
    ],
)
def test_secrets_along_chains(spark, modes, lost):
    calls = spark.createDataFrame([(k, k + 1, 0, m, p) for k, (m, p) in enumerate(modes, 1)], "src long, dst long, ord int, mode string, map map<string,string>")
    leaf = len(modes) + 1
    rows = secrets.lost(calls, spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(leaf, "X")], "node long, secret string")).collect()
    assert [r["dropped_at"] for r in rows] == ([] if lost is None else [lost])
    assert all(r["kind"] == ("MissingSecretPropagation" if len(modes) == 1 else "SecretsInheritChainBreak") for r in rows)


def test_search_counts_bytes(spark):
    nodes = spark.createDataFrame([(1, "Éa", "é abc"), (2, "x", "abc é"), (3, "y", "abc")], "id long, label string, text string")
    assert {r["id"]: r["score"] for r in search.scored(nodes, "abc é").collect()} == {1: 253 + 256, 2: 256 + 252}
    assert search.scored(nodes, " ").count() == 0


def test_incremental_refresh(spark, tmp_path):
    before = spark.createDataFrame([("a", 1), ("b", 1), ("gone", 1)], "file string, mtime int")
    now = spark.createDataFrame([("a", 1), ("b", 2), ("new", 1)], "file string, mtime int")
    cached = spark.createDataFrame([("a", "old"), ("b", "old"), ("gone", "old")], "file string, v string")
    rows = refresh.merge(cached, before, now, lambda stale: stale.withColumn("v", F.lit("fresh"))).collect()
    assert sorted((r["file"], r["v"], r["origin"]) for r in rows) == [("a", "old", "cached"), ("b", "fresh", "parsed"), ("new", "fresh", "parsed")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("one\ntwo")
    stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    refresh.watch(stream, lambda batch: batch, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("seed", range(2))
def test_a_key_of_most_rows_is_swept_in_parts(spark, seed):
    """Nodes, ends and ranges of buckets far before or behind are carried, over empty buckets too; null keys are a key."""
    chance = random.Random(seed)
    key = lambda: chance.choice([1, 1, 1, 1, 2, None])
    rows = [(k, key(), chance.randrange(2000)) for k in range(300)]
    nodes = [(k, key(), chance.randrange(2000)) for k in range(12)]
    r, n = spark.createDataFrame(rows, "row long, key long, at long"), spark.createDataFrame(nodes, "node long, key long, at long")
    got = {x["row"]: x["node"] for x in joins.asof_forward(r, n, "key", "at", "row", "node", F.expr("at div 50")).collect()}
    assert got == {k: min(((a, i) for i, q, a in nodes if q == key and a > at), default=(0, None))[1] for k, key, at in rows}
    ranges = [(q, a, a + chance.choice([1, 40, 900])) for _, q, a in nodes]
    free = joins.outside_ranges(r, spark.createDataFrame(ranges, "key long, lo long, hi long"), "key", "at", "lo", "hi", 50)
    assert sorted(x["row"] for x in free.collect()) == [k for k, key, at in rows if not any(q == key and lo <= at < hi for q, lo, hi in ranges)]
