"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over hashed text features.
A later model also gets the probabilities of the earlier categories. In training these
are out-of-fold predictions (of models that haven't seen the row), so a later model
doesn't trust them more than new texts will bear out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import common, features

MAX_LABELLED = 4_000  # labelled rows that the fit reads, the only bound here
FOLDS = 3
THRESHOLD = 0.5


class Link(NamedTuple):
    """A model of the chain: weights by text feature, a weight for each earlier probability, a constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def predict(self, scores: np.ndarray, before: np.ndarray) -> np.ndarray:
        return features.sigmoid(scores + before @ self.earlier + self.constant)


def fit_link(rows: features.Rows, y: np.ndarray, before: np.ndarray, l2: float = 1e-4, steps: int = 150) -> Link:
    """Regularised logistic regression; without both labels a constant."""
    n, extra = len(y), before.shape[1]
    if len(np.unique(y)) < 2:
        return Link(np.zeros(1 << features.BITS), np.zeros(extra), 20.0 if n and y[0] else -20.0)
    scale = features.telling(rows, y > 0.5)
    x, used = features.numbered(features.scaled(rows, scale))
    size = len(used)

    def gradient(p: np.ndarray) -> np.ndarray:
        error = features.sigmoid(x.times(p[:size]) + before @ p[size:-1] + p[-1]) - y
        return np.concatenate([x.back(error, size) / n + l2 * p[:size], error @ before / n + l2 * p[size:-1], [error.mean()]])

    p = features.minimise(gradient, size + extra + 1, steps)
    return Link(features.spread(p[:size], used, scale), p[size:-1], float(p[-1]))


def fit_chain(rows: features.Rows, labels: np.ndarray, folds: int = FOLDS) -> list[Link]:
    """One link for each column of ``labels``, in order."""
    n, count = labels.shape
    fold, before, chain = np.arange(n) % folds, np.zeros((n, 0)), []
    for k in range(count):
        chain.append(fit_link(rows, labels[:, k], before))
        if k + 1 < count:
            apart = np.zeros(n)
            for f in range(folds):
                seen, held = fold != f, fold == f
                model = fit_link(rows.take(seen), labels[seen, k], before[seen])
                apart[held] = model.predict(rows.take(held).times(model.weights), before[held])
            before = np.column_stack([before, apart])
    return chain


def predict_chain(chain: list[Link], scores: np.ndarray) -> np.ndarray:
    """Probabilities of all categories from the text scores under each link."""
    before = np.zeros((len(scores), 0))
    for k, link in enumerate(chain):
        before = np.column_stack([before, link.predict(scores[:, k], before)])
    return before


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", bound: int = MAX_LABELLED) -> list[Link]:
    """The chain for ``categories``, fitted in one task on at most ``bound`` labelled rows; only the links come to the driver."""
    rows = features.labelled(docs, labels, categories, id_col, text_col, bound)
    made = features.fitted(rows, lambda x, y: [(c.weights, c.earlier, np.array([c.constant])) for c in fit_chain(x, y)], share=False)
    return [Link(weights, earlier, float(constant[0])) for weights, earlier, constant in made]


def scorer(docs: DataFrame, chain: list[Link], categories: list[str]):
    """A function from a text column to a struct of a probability p_<category> for each category."""
    sent = docs.sparkSession.sparkContext.broadcast([Link(c.weights.astype(np.float32), c.earlier, c.constant) for c in chain])
    names = [f"p_{c}" for c in categories]

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain = sent.value
        together = np.column_stack([c.weights for c in chain])
        for series in texts:
            scores = np.zeros((len(series), len(chain)))
            for k, text in enumerate(series):
                numbers, _ = features.hashed(text)
                scores[k] = together[numbers].sum(axis=0)
            yield pd.DataFrame(predict_chain(chain, scores), columns=names)

    return score


def classify(docs: DataFrame, chain: list[Link], categories: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: id, a probability for each category, toxic (the last category's is at least ``threshold``).

    Null, empty and wordless texts have no features and get what the constants alone say;
    repeated rows and null ids keep a row each; an empty table gives an empty result;
    other columns are left out. One pass without a shuffle.
    """
    score = scorer(docs, chain, categories)
    scored = docs.select(F.col(id_col).alias("id"), score(F.col(text_col).cast("string")).alias("s"))
    return scored.select(F.col("id").alias(id_col), "s.*", (F.col(f"s.p_{categories[-1]}") >= threshold).alias("toxic"))


def reject(docs: DataFrame, chain: list[Link], categories: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic.

    Null, empty and wordless texts have no features: the constants alone judge them, so
    they stay as long as toxic texts are the lesser part of the training rows. Repeated rows
    and null ids are judged each; an empty table stays empty.
    """
    name, score = common.fresh(docs, "toxicity"), scorer(docs, chain, categories)
    return docs.withColumn(name, score(F.col(text_col).cast("string"))).where(F.col(f"{name}.p_{categories[-1]}") < threshold).drop(name)
