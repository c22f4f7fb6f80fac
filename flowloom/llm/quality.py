"""Quality classifier: ordinal regression with cumulative links on graded ratings.

P(grade > k) = sigmoid(w x - t_k): one weight vector over hashed text features for all
grades, and ordered thresholds t_0 < t_1 < ... between them. It gives an expected grade
and the probability of the upper grades, by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm import common, features

MAX_LABELLED = 4_000  # rated rows that the fit reads, the only bound here
KEEP_PROBABILITY = 0.5


class OrdinalModel(NamedTuple):
    grades: np.ndarray  # ascending
    weights: np.ndarray  # by feature
    thresholds: np.ndarray  # ascending, one less than grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each k but the last, a row for each score."""
        return features.sigmoid(scores[:, None] - self.thresholds[None, :])

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(scores) @ np.diff(self.grades)

    def tail(self, scores: np.ndarray, grade: float | None = None) -> np.ndarray:
        """P(grade >= ``grade``), of the top grade if none is given."""
        k = len(self.grades) - 1 if grade is None else int(np.searchsorted(self.grades, grade))
        if not len(self.thresholds) or k <= 0:
            return np.ones(len(scores))
        return self.tails(scores)[:, k - 1] if k < len(self.grades) else np.zeros(len(scores))


def fit(rows: features.Rows, ratings: np.ndarray, l2: float = 1e-4, steps: int = 150) -> OrdinalModel:
    """Fit by maximum likelihood. Without two different grades the model is constant."""
    grades = np.unique(ratings)
    if len(grades) < 2:
        return OrdinalModel(grades if len(grades) else np.array([0.0]), np.zeros(1 << features.BITS), np.zeros(0))
    level, cuts = np.searchsorted(grades, ratings), len(grades) - 1
    scale = features.telling(rows, level > (cuts - 1) // 2)
    x, used = features.numbered(features.scaled(rows, scale))
    size, n = len(used), len(ratings)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(p[1:], -10, 10)))])

    def gradient(p: np.ndarray) -> np.ndarray:
        scores, t = x.times(p[:size]), thresholds(p[size:])
        below = np.concatenate([np.zeros((n, 1)), features.sigmoid(t[None, :] - scores[:, None]), np.ones((n, 1))], axis=1)
        each, row = below * (1 - below), np.arange(n)
        chance = np.maximum(below[row, level + 1] - below[row, level], 1e-12)
        by_score = (each[row, level + 1] - each[row, level]) / chance
        by_cut = np.zeros(cuts)
        for k in range(cuts):
            by_cut[k] = (-(each[:, k + 1] / chance)[level == k].sum() + (each[:, k + 1] / chance)[level == k + 1].sum()) / n
        steps_ = np.exp(np.clip(p[size + 1 :], -10, 10)) * np.cumsum(by_cut[::-1])[::-1][1:]
        return np.concatenate([x.back(by_score, size) / n + l2 * p[:size], [by_cut.sum()], steps_])

    p = features.minimise(gradient, size + cuts, steps)
    return OrdinalModel(grades, features.spread(p[:size], used, scale), thresholds(p[size:]))


def train(docs: DataFrame, labels: DataFrame, rating_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = MAX_LABELLED) -> OrdinalModel:
    """The model of the ratings, fitted in one task on at most ``bound`` rated rows; only the model comes to the driver."""
    rows = features.labelled(docs, labels, [rating_col], id_col, text_col, bound)
    return OrdinalModel(*features.fitted(rows, lambda x, y: [tuple(fit(x, y[:, 0]))], share=True)[0])


def scorer(docs: DataFrame, model: OrdinalModel, grade: float | None = None):
    """A function from a text column to a struct of expected grade and tail probability."""
    sent = docs.sparkSession.sparkContext.broadcast(OrdinalModel(model.grades, model.weights.astype(np.float32), model.thresholds))

    @F.pandas_udf("expected_grade double, tail_probability double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for series in texts:
            scores = np.zeros(len(series))
            for k, text in enumerate(series):
                numbers, counts = features.hashed(text)
                scores[k] = float(model.weights[numbers] @ features.share_values(counts)) if len(numbers) else 0.0
            yield pd.DataFrame({"expected_grade": model.expected(scores), "tail_probability": model.tail(scores, grade)})

    return score


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP_PROBABILITY) -> DataFrame:
    """Per row of ``docs``: id, expected_grade, tail_probability (of the top grade), keep (tail_probability >= keep).

    Null, empty and wordless texts have no features and get what the thresholds alone
    say; repeated rows and null ids keep a row each; an empty table gives an empty
    result; other columns are left out. One pass without a shuffle.
    """
    score = scorer(docs, model)
    scored = docs.select(F.col(id_col).alias("id"), score(F.col(text_col).cast("string")).alias("s"))
    return scored.select(F.col("id").alias(id_col), "s.*", (F.col("s.tail_probability") >= keep).alias("keep"))


def select(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep: float = KEEP_PROBABILITY) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept.

    Null, empty and wordless texts have no features: the thresholds alone judge them.
    Repeated rows and null ids are judged each; an empty table stays empty.
    """
    name, score = common.fresh(docs, "grade"), scorer(docs, model)
    scored: Column = F.col(f"{name}.tail_probability")
    return docs.withColumn(name, score(F.col(text_col).cast("string"))).where(scored >= keep).drop(name)
