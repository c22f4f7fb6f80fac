"""Similar documents for any threshold against all pairs."""

import random

import numpy as np
import pytest

from flowloom.operators import dedup


def corpus(seed):
    """Random sets with empty kinds, copies and near copies, and tokens that most documents have."""
    dice = random.Random(seed)
    docs = {}
    for d in range(40):
        if d > 5 and dice.random() < 0.4:
            docs[d] = {k: set(v) for k, v in docs[dice.randrange(d)].items()}
            if dice.random() < 0.6:
                docs[d][dice.choice(["use", "run", "trigger"])].add(f"x{d}")
        else:
            docs[d] = {k: {f"{k}{min(dice.randrange(n), dice.randrange(n))}" for _ in range(dice.randint(0, m))} for (k, _), n, m in zip(dedup.WEIGHTS, (3, 6, 12, 30), (2, 3, 6, 12))}
    return {d: sets for d, sets in docs.items() if any(sets.values())}


def similarity(a, b):
    total = None
    for kind, weight in dedup.WEIGHTS:
        both, union = len(a[kind] & b[kind]), len(a[kind] | b[kind])
        term = np.float32(weight) * np.float32(both / union if union else 1.0)
        total = term if total is None else np.float32(total + term)
    return total


@pytest.mark.parametrize("seed, threshold", [(1, 0.1), (2, 0.3), (3, 0.5), (4, 0.6), (5, 0.8), (6, 0.95), (7, 1.0)])
def test_pairs_equal_all_pairs(spark, seed, threshold):
    docs = corpus(seed)
    rows = [(d, k, t) for d, sets in docs.items() for k, tokens in sets.items() for t in tokens]
    features = spark.createDataFrame(rows + rows[:20], "doc long, kind string, token string").repartition(3)
    want = {(a, b): float(s) for a in docs for b in docs if a < b and (s := similarity(docs[a], docs[b])) >= np.float32(threshold)}
    got = dedup.similar_pairs(features, threshold).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == pytest.approx(want) and len(got) == len(want) and want
    roots = {d: d for d in docs}
    for _ in docs:
        for a, b in want:
            roots[a] = roots[b] = min(roots[a], roots[b])
    found = {r["doc"]: r["representative"] for r in dedup.similar_clusters(features, threshold).collect()}
    assert found == {d: roots[d] for d in docs if any(d in p for p in want)}


def test_no_threshold_refused_but_none(spark):
    with pytest.raises(ValueError):
        dedup.similar_pairs(spark.createDataFrame([], "doc long, kind string, token string"), 0.0)
    assert dedup.similar_pairs(spark.createDataFrame([], "doc long, kind string, token string"), 0.2).count() == 0


def test_rows_of_whole_documents_equal_features(spark, monkeypatch):
    """Only hashes move; with lists of any length, repeated rows, null arrays and documents without tokens."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(dedup, "LONG", 2)
    kinds = [k for k, _ in dedup.WEIGHTS]
    docs = [(d, *[sorted(sets[k]) for k in kinds]) for d, sets in corpus(5).items()]
    again = [*docs, docs[0], (docs[1][0], ["t"], ["j"], ["u", "u"], []), (1000, [], [], [], []), (1001, ["t"], None, ["u"], ["r"])]
    table = spark.createDataFrame(again, "doc long, " + ", ".join(f"{k} array<string>" for k in kinds)).repartition(3)
    sets = dedup.hashed_rows(table, {k: F.col(k) for k in kinds})
    assert {t for n, t in sets.dtypes if n != "doc"} == {"array<bigint>"}
    features = spark.createDataFrame([(r[0], k, t) for r in again[:-1] for k, tokens in zip(kinds, r[1:]) for t in tokens], "doc long, kind string, token string")
    want, got = (sorted(map(tuple, dedup.similar_pairs(x).collect())) for x in (features, sets))
    assert got == want and want
    members, whole = dedup.clustered(sets)
    uses = {(r[0], r[2]) for r in dedup.uses_by_cluster(members, whole).groupBy("representative", "common").count().select("representative", "count", "common").collect()}
    assert {r["representative"] for r in members.collect()} >= {u for u, _ in uses}
