import random
import re

import numpy as np
import pytest

from flowloom.llm import jaccard


def brute(docs, shingle=5):
    """(id, set size, smallest linked id) by comparing all pairs."""
    sets = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    by = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        counts = {}
        for x in s:
            for j in by[x]:
                if j < k:
                    counts[j] = counts.get(j, 0) + 1
        for j, n in counts.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)), key=str)


def answer(docs):
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(docs).collect()), key=str)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(docs.select("doc_id", "text").collect())
    assert answer(docs) == want and sum(c != i for i, _, c in want) > 10


def test_odd_rows(odd, empty):
    assert answer(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert answer(empty) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_groups_and_chains(spark, seed, monkeypatch):
    chance = random.Random(seed)
    rows, base = [], [f"w{chance.randint(0, 30)}" for _ in range(60)]
    for _ in range(150):  # near copies that drift apart, around the threshold
        words = list(base)
        for _ in range(chance.randint(0, 3)):
            words[chance.randrange(len(words))] = f"x{chance.randint(0, 5)}"
        rows.append(" ".join(words))
        if chance.random() < 0.1:
            base = words
    line = " ".join(f"c{k}" for k in range(12))
    rows += [line + " " + " ".join(f"v{chance.randint(0, 9)}" for _ in range(chance.randint(0, 8))) for _ in range(80)]
    docs = list(enumerate(rows))
    chance.shuffle(docs)
    assert answer(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == brute(docs)


@pytest.mark.parametrize("hot, block, common", [(5, 3, 1_000_000), (20, 7, 50)])
def test_dealt_lists(spark, monkeypatch, hot, block, common):
    """Lists over several groups and blocks, and few known counts."""
    for name, value in (("HOT", hot), ("BLOCK", block), ("MAX_COMMON", common)):
        monkeypatch.setattr(jaccard, name, value)
    chance = random.Random(hot)
    shared = [f"s{k}" for k in range(40)]
    docs = [(k, " ".join(shared[: chance.randint(25, 40)] + [f"t{chance.randint(0, 3)}" for _ in range(chance.randint(0, 9))])) for k in range(200)]
    assert answer(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == brute(docs)


def test_numbers_that_clash(spark, monkeypatch):
    """Different sets of one number are told apart by the check."""
    monkeypatch.setattr(jaccard.Join, "counted", lambda self: jaccard.Common(np.zeros(0, np.uint32), np.zeros(0, np.float32), 1.0, frozenset([number])))
    texts = ["a b c d e f g h", "a b c d e f g h", "k l m n o p q r"]
    number, check = jaccard.class_of(jaccard.shingle_sets(texts[:1])[0])
    assert jaccard.class_of(jaccard.shingle_sets(texts[:1])[0], frozenset([number])) == (check, number)
    docs = list(enumerate(texts))
    assert answer(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_clashes_are_found(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "class_of", lambda tokens, clashes=frozenset(): (7, int(tokens[0] >> np.uint64(2))))
    docs = spark.createDataFrame([(1, 1, "a b c d e f"), (2, 2, "x y z u v w")], "id long, key long, text string")
    assert jaccard.Join(docs.coalesce(1), 5, 80).common.value.clashes == {7}
    assert jaccard.Join(docs.repartition(2, "id"), 5, 80).common.value.clashes == {7}


@pytest.mark.parametrize("n", [1, 900, 5_000, 70_000])
def test_stored_sets(n):
    chance = np.random.default_rng(n)
    x = np.unique(chance.integers(0, 2**64, n, np.uint64))
    y = np.unique(np.concatenate([x[: n * 9 // 10], chance.integers(0, 2**64, n // 7, np.uint64)]))
    assert jaccard.shared_tokens(jaccard.set_bytes(x), len(x), jaccard.set_bytes(y), len(y)) == n * 9 // 10
    differ = len(np.setxor1d(x, y))
    assert jaccard.differ_at_least(jaccard.long_sketch(x), jaccard.long_sketch(y)) <= differ
    assert (jaccard.width_of(1_024), jaccard.width_of(1_025), jaccard.width_of(1 << 22)) == (5, 6, 8)


def test_one_of_each(odd):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (102, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in jaccard.components(links).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_a_pair_is_made_once_for_all_its_tokens(spark):
    """Classes of three components share 40 of 60 tokens; their pairs are made at one of these, not at each."""
    import random

    dice = random.Random(3)
    tokens = {c: {dice.randrange(-(1 << 62), 1 << 62) for _ in range(20)} for c in range(9)}
    shared = [dice.randrange(-(1 << 62), 1 << 62) for _ in range(40)]
    open_ = spark.createDataFrame([(t, c, 60 * jaccard.MAX_MATCHES, c % 3) for c, own in tokens.items() for t in [*shared, *own]], "token long, cls long, shape long, root long")
    sketches = spark.createDataFrame([(c, 60, None, *[0] * jaccard.SKETCH) for c in tokens], "cls long, n long, long binary, " + ", ".join(f"{s} long" for s in jaccard.SKETCHES))
    join = object.__new__(jaccard.Join)
    join.percent = 80
    found = [(r["a"], r["b"]) for r in join.all_pairs(open_, sketches).collect()]
    assert sorted(found) == [(a, b) for a in range(9) for b in range(a + 1, 9) if a % 3 != b % 3]
