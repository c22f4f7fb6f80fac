"""The classifiers' fits and scores against versions written out from their definitions."""

import math
import random

import numpy as np
import pytest

from flowloom.llm import features, quality, toxicity

WORDS = "good fine plain bad awful river stone light paper window".split()


def texts_of(seed, n, favourites):
    """n texts with a level each; a level's favourite words are more frequent in its texts."""
    chance = random.Random(seed)
    levels = [chance.randrange(len(favourites)) for _ in range(n)]
    return [" ".join(chance.choice(WORDS + [favourites[v]] * 4) for _ in range(chance.randint(3, 20))) for v in levels], levels


def rows_of(texts, values):
    return features.Rows.of([(n, values(c)) for n, c in map(features.hashed, texts)])


def dense(rows, size):
    out = np.zeros((len(rows.starts) - 1, size))
    for k in range(len(out)):
        for at in range(rows.starts[k], rows.starts[k + 1]):
            out[k, rows.numbers[at]] += rows.values[at]
    return out


def test_gradient_of_the_ordinal_fit(monkeypatch):
    texts, levels = texts_of(1, 60, ["bad", "plain", "good", "fine"])
    grades = np.array([1.0, 2.0, 5.0, 7.0])
    rows, caught = rows_of(texts, features.share_values), []
    monkeypatch.setattr(features, "minimise", lambda gradient, size, *a, **k: caught.append(gradient) or np.zeros(size))
    quality.fit(rows, grades[levels])
    level = np.array(levels)
    scale = features.telling(rows, level > 1)
    x, used = features.numbered(features.scaled(rows, scale))
    x, size = dense(x, len(used)), len(used)

    def loss(p):
        scores, t = x @ p[:size], [p[size]]
        for step in p[size + 1 :]:
            t.append(t[-1] + math.exp(step))
        total = 0.0
        for s, v in zip(scores, levels):
            above = [1.0, *(1 / (1 + math.exp(c - s)) for c in t), 0.0]  # P(grade > k) from below all to above all
            total -= math.log(above[v] - above[v + 1])
        return total / len(levels) + 1e-4 / 2 * float(p[:size] @ p[:size])

    p = np.random.default_rng(3).normal(0, 0.3, size + 3)
    got = caught[0](p)
    for k in [*range(0, size, max(1, size // 15)), size, size + 1, size + 2]:
        step = np.zeros(len(p))
        step[k] = 1e-5
        assert got[k] == pytest.approx((loss(p + step) - loss(p - step)) / 2e-5, rel=1e-4, abs=1e-8)


def test_expected_grades_and_tails_by_hand(spark):
    texts, levels = texts_of(2, 200, ["bad", "plain", "good"])
    grades = np.array([0.0, 1.0, 4.0])
    model = quality.fit(rows_of(texts, features.share_values), grades[levels])
    asked = [(k, t) for k, t in enumerate([*texts[:40], "", None, "unseen " * 5])]
    got = {r["doc_id"]: r for r in quality.grade_documents(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for k, text in asked:
        numbers, counts = features.hashed(text)
        total = sum(counts.tolist())
        score = sum(np.float32(model.weights[n]) * math.sqrt(c / total * 3) for n, c in zip(numbers.tolist(), counts.tolist()))
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        chances = [1 - above[0], above[0] - above[1], above[1]]
        assert got[k]["expected_grade"] == pytest.approx(sum(c * g for c, g in zip(chances, grades)), abs=1e-4)
        assert got[k]["tail_probability"] == pytest.approx(above[1], abs=1e-4) and got[k]["keep"] == (got[k]["tail_probability"] >= 0.5)


def test_later_links_see_out_of_fold_probabilities():
    texts, levels = texts_of(4, 90, ["bad", "awful", "good", "fine"])
    labels = np.array([[v in (0, 1), v == 0, v == 3] for v in levels], float)
    rows = rows_of(texts, features.presence_values)
    chain = toxicity.fit_chain(rows, labels, folds=3)
    before = np.zeros((90, 0))
    for k in range(3):
        again = toxicity.fit_link(rows, labels[:, k], before)
        assert np.allclose(again.weights, chain[k].weights) and np.allclose(again.earlier, chain[k].earlier) and again.constant == pytest.approx(chain[k].constant)
        apart = [None] * 90
        for fold in range(3):
            others = [i for i in range(90) if i % 3 != fold]
            mask = np.isin(np.arange(90), others)
            link = toxicity.fit_link(rows_of([texts[i] for i in others], features.presence_values), labels[mask, k], before[mask])
            for i in range(fold, 90, 3):
                score = sum(link.weights[n] for n in features.hashed(texts[i])[0]) + sum(a * b for a, b in zip(before[i], link.earlier)) + link.constant
                apart[i] = 1 / (1 + math.exp(-score))
        before = np.column_stack([before, apart])


def test_gradient_of_a_link(monkeypatch):
    texts, levels = texts_of(5, 50, ["bad", "good"])
    rows, y, before, caught = rows_of(texts, features.presence_values), np.array(levels, float), np.random.default_rng(1).random((50, 2)), []
    monkeypatch.setattr(features, "minimise", lambda gradient, size, *a, **k: caught.append(gradient) or np.zeros(size))
    toxicity.fit_link(rows, y, before)
    x, used = features.numbered(features.scaled(rows, features.telling(rows, y > 0.5)))
    whole = np.column_stack([dense(x, len(used)), before, np.ones(50)])

    def loss(p):
        return sum(math.log1p(math.exp(-s if v else s)) for s, v in zip(whole @ p, levels)) / 50 + 1e-4 / 2 * float(p[:-1] @ p[:-1])

    p = np.random.default_rng(2).normal(0, 0.2, len(used) + 3)
    got = caught[0](p)
    for k in [*range(0, len(used), max(1, len(used) // 15)), len(used), len(used) + 1, len(used) + 2]:
        step = np.zeros(len(p))
        step[k] = 1e-5
        assert got[k] == pytest.approx((loss(p + step) - loss(p - step)) / 2e-5, rel=1e-4, abs=1e-8)
