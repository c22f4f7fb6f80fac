"""Hashed text features and linear models over them, shared by the classifiers."""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
MAX_MEMO = 200_000

_letters = (re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1+"))


def shape_of(word: str) -> str:
    """A word's shape: runs of capitals, small letters, digits and equal marks become one sign each."""
    word = _letters[3].sub(r"\1\1", word[:64])
    return _letters[2].sub("0", _letters[1].sub("a", _letters[0].sub("AA", word)))


def _slot(kind: str, value: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind}\x00{value}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


_memo: dict[str, tuple[int, int, int]] = {}


def slots_of(word: str) -> tuple[int, int, int]:
    """Feature numbers of a word: itself, its first five letters, its shape."""
    if (found := _memo.get(word)) is None:
        if len(_memo) >= MAX_MEMO:
            _memo.clear()
        low = word.lower()
        found = _memo[word] = (_slot("w", low.strip(".,;:!?%&$#*|\"'()")), _slot("p", low[:5]), _slot("s", shape_of(word)))
    return found


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a whole text, ascending, and their counts; no features without words."""
    words = text.split() if text else None
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts, n = Counter(words), len(words)
    slots = np.array([slots_of(w) for w in counts], np.int64)
    # Of the text as a whole: how often a word follows itself, and how many of the words differ.
    repeats = sum(map(operator.eq, words, words[1:])) / n
    whole = [_slot("r", str(min(9, math.ceil(repeats * 20)))), _slot("d", str(len(counts) * 10 // n if n >= 30 else -1))]
    times = np.append(np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), 3), [n, n])
    numbers, place = np.unique(np.append(slots.ravel(), whole), return_inverse=True)
    return numbers.astype(np.int32), np.bincount(place, times).astype(np.float32)


class Rows(NamedTuple):
    """Sparse rows: row k has numbers[starts[k]:starts[k+1]]."""

    starts: np.ndarray
    numbers: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        sizes = [len(n) for n, _ in rows]
        flat = lambda k, kind: np.concatenate([r[k] for r in rows]).astype(kind) if rows else np.zeros(0, kind)
        return cls(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat(0, np.int32), flat(1, np.float32))

    def times(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.values * weights[self.numbers])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def back(self, errors: np.ndarray, size: int = 1 << BITS) -> np.ndarray:
        return np.bincount(self.numbers, self.values * np.repeat(errors, np.diff(self.starts)), minlength=size)

    def take(self, keep: np.ndarray) -> Rows:
        where = np.flatnonzero(keep)
        return Rows.of([(self.numbers[self.starts[k] : self.starts[k + 1]], self.values[self.starts[k] : self.starts[k + 1]]) for k in where])


def telling(rows: Rows, positive: np.ndarray, least: int = 4) -> np.ndarray:
    """A weight for each feature: how far its frequency differs between the two sides; 0 in fewer than ``least`` rows.

    Rare features would let a model learn its training texts by heart.
    """
    present = Rows(rows.starts, rows.numbers, np.ones_like(rows.values))
    a, b = present.back(positive.astype(float)), present.back(1.0 - positive)
    ratio = np.log((a + 0.5) / (positive.sum() + 1)) - np.log((b + 0.5) / ((1 - positive).sum() + 1))
    return np.where(a + b >= least, np.abs(ratio), 0.0)


def scaled(rows: Rows, scale: np.ndarray) -> Rows:
    """Rows with each feature multiplied by its scale, without those that become 0."""
    values = rows.values * scale[rows.numbers]
    kept = values != 0
    ends = np.concatenate([[0], np.cumsum(kept)])
    return Rows(ends[rows.starts], rows.numbers[kept], values[kept])


def numbered(rows: Rows) -> tuple[Rows, np.ndarray]:
    """Rows with only the features that occur, numbered anew; and their old numbers."""
    used, numbers = np.unique(rows.numbers, return_inverse=True)
    return Rows(rows.starts, numbers.astype(np.int32), rows.values), used


def spread(weights: np.ndarray, used: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights of features numbered anew as weights of all, by their scales."""
    out = np.zeros(len(scale))
    out[used] = weights * scale[used]
    return out


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], id_col: str, text_col: str, bound: int) -> DataFrame:
    """Features and labels of at most ``bound`` labelled rows (the smallest hashes of id and labels): numbers, counts, place, y0, y1, ...

    Rows with a null among their labels are left out; of several texts of an id the one
    with the least hash counts. ``place`` is a hash of id and labels.
    """
    known = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(columns)]).dropna()
    known = known.orderBy(F.xxhash64("id", *[f"y{k}" for k in range(len(columns))])).limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ys = [f"y{k}" for k in range(len(columns))]
    both = texts.join(F.broadcast(known), "id").groupBy("id", *ys).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    both = both.select("text", F.xxhash64("id", *ys).alias("place"), *ys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [hashed(t.as_py()) for t in batch.column("text")]
            numbers, counts = pa.array([n for n, _ in rows], pa.list_(pa.int32())), pa.array([c for _, c in rows], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([numbers, counts, *batch.columns[1:]], ["numbers", "counts", *batch.schema.names[1:]])

    kinds = ", ".join(f"{y} double" for y in ys)
    return both.mapInArrow(run, f"numbers array<int>, counts array<float>, place long, {kinds}")


def fitted(rows: DataFrame, fit: Callable[[Rows, np.ndarray], list[tuple[np.ndarray, ...]]], share: bool) -> list[tuple[np.ndarray, ...]]:
    """What ``fit`` makes of the rows of ``labelled``: tuples of arrays of floats. It is called in one task; only the arrays come to the driver.

    Rows are ordered by ``place``, so partitions don't matter.
    """
    ys, values = [c for c in rows.columns if c.startswith("y")], share_values if share else presence_values

    def fit_table(found: pa.Table) -> list[tuple[np.ndarray, ...]]:
        found = found.sort_by([(c, "ascending") for c in ("place", *ys)]).combine_chunks()
        x = Rows.of([(np.asarray(n.values), values(np.asarray(c.values))) for n, c in zip(found.column("numbers"), found.column("counts"))])
        return fit(x, np.array([found.column(y).to_numpy() for y in ys]).T.reshape(-1, len(ys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if all_ := list(batches):
            parts = [pa.array([np.asarray(p, np.float64) for p in model], pa.list_(pa.float64())) for model in fit_table(pa.Table.from_batches(all_))]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.list_(pa.float64())))], ["parts"])

    made = rows.repartition(1).mapInArrow(run, "parts array<array<double>>").toArrow().column("parts")
    if not len(made):  # no labelled rows
        return fit(Rows.of([]), np.zeros((0, len(ys))))
    return [tuple(np.array(p.values) for p in model.values) for model in made]


def share_values(counts: np.ndarray) -> np.ndarray:
    """Counts as square roots of shares: a text's length doesn't matter."""
    return np.sqrt(counts / counts.sum() * 3) if len(counts) else counts


def presence_values(counts: np.ndarray) -> np.ndarray:
    """1 for each feature, so that a few telling words weigh the same in long texts."""
    return np.ones_like(counts)


def minimise(gradient, size: int, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Adam on a full gradient, from zero."""
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))
