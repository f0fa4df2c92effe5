"""Toxicity by a classifier chain: each category's linear model also sees those before it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Labelled rows that are fitted on at most, picked by a hash of doc_id.
SAMPLE_ROWS = 6000
FOLDS = 5
SLOTS = 1 << 18
#: Beginnings of words that are features beside the word itself: they stand for all its forms.
PREFIXES = (4, 5, 6)
#: Features of a model at most: those that tell a category's rows apart most surely, in so many rows at least.
FEATURES, MIN_ROWS = 400, 3
STEPS, RATE, L2 = 300, 0.3, 1e-4

_WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str | None) -> set[str]:
    """The different words of a text: runs of letters, lower case."""
    return set(_WORD.findall((text or "").lower()))


def slots_of(word: str) -> list[int]:
    """The slots of a word and of its beginnings."""
    parts = [f"{word}$", *[word[:n] for n in PREFIXES if len(word) > n]]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) % SLOTS for p in parts]


class Matrix:
    """Rows of feature counts, as one list of slots with the rows' ends."""

    def __init__(self, rows: list[np.ndarray]):
        self.slots = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.width = len(rows), SLOTS

    def only(self, slots: np.ndarray) -> "Matrix":
        """The same rows with these slots alone, numbered by their place in the list."""
        number = np.full(SLOTS, -1)
        number[slots] = np.arange(len(slots))
        out, keep = Matrix([]), number[self.slots] >= 0
        out.slots, out.owner, out.n, out.width = number[self.slots[keep]], self.owner[keep], self.n, len(slots)
        return out

    def telling(self, y: np.ndarray) -> np.ndarray:
        """The slots whose number of positive rows is furthest from chance, by its standard deviation."""
        first = np.r_[True, (self.slots[1:] != self.slots[:-1]) | (self.owner[1:] != self.owner[:-1])][: len(self.slots)]
        slots, owner = self.slots[first], self.owner[first]
        rows, base = np.bincount(slots, minlength=SLOTS), y.mean()
        hits = np.bincount(slots, weights=y[owner], minlength=SLOTS)
        far = np.abs(hits - rows * base) / np.sqrt(np.maximum(rows * base * (1 - base), 1e-9))
        far[rows < MIN_ROWS] = 0
        best = np.argsort(-far, kind="stable")[:FEATURES]
        return best[far[best] > 3]

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=weights[self.slots], minlength=self.n)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.slots, weights=values[self.owner], minlength=self.width)


@dataclass
class Linear:
    weights: np.ndarray
    earlier: np.ndarray  # of the earlier categories' probabilities
    bias: float

    def probabilities(self, x: Matrix, before: np.ndarray) -> np.ndarray:
        return _logistic(x.times(self.weights) + before @ self.earlier + self.bias)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Matrix, before: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression on the telling features, by gradient steps whose length adapts to each weight."""
    telling = x.telling(y)
    x = x.only(telling)
    weights, earlier, bias = np.zeros(x.width), np.zeros(before.shape[1]), 0.0
    seen = [np.full(x.width, 1e-8), np.full(before.shape[1], 1e-8), 1e-8]
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(STEPS):
        off = (_logistic(x.times(weights) + before @ earlier + bias) - y) * balance / max(len(y), 1)
        moves = [x.back(off) + L2 * weights, before.T @ off, off.sum()]
        seen = [s + m * m for s, m in zip(seen, moves, strict=True)]
        steps = [RATE * m / np.sqrt(s) for s, m in zip(seen, moves, strict=True)]
        weights, earlier, bias = weights - steps[0], earlier - steps[1], bias - steps[2]
    spread = np.zeros(SLOTS)
    spread[telling] = weights
    return Linear(spread, earlier, float(bias))


@dataclass
class Chain:
    """The models in order, and of each category the probability from which it holds."""

    categories: list[str]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, categories: list[str]) -> Chain:
    """Fit the categories in order.

    What a model sees of an earlier category is that category's out-of-fold
    probability: of each row by a model that was fitted on the other folds, as
    it will be for texts that no model has seen.  The threshold is the one with
    the highest F1 on these.
    """
    chain, x = Chain(categories), Matrix(rows)
    fold = np.arange(len(rows)) % FOLDS
    before = np.zeros((len(rows), 0))
    for k in range(len(categories)):
        y, out = labels[:, k].astype(float), np.zeros(len(rows))
        for f in range(FOLDS):
            rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part = fit_linear(Matrix([rows[i] for i in rest]), before[rest], y[rest])
            out[own] = part.probabilities(Matrix([rows[i] for i in own]), before[own])
        chain.models.append(fit_linear(x, before, y))
        chain.thresholds.append(_best_threshold(out, y))
        before = np.column_stack([before, out])
    return chain


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Between the neighbours where F1 is highest; 0.5 without a positive row."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not len(p) or hits[-1] == 0:
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    k = int(np.argmax(f1))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0.0)) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = SAMPLE_ROWS) -> Chain:
    """A chain fitted on about ``sample_rows`` documents at most of those that ``labels`` covers.

    ``labels`` has doc_id and a 0/1 column for each category; of several rows
    of a document the larger labels hold, and rows with a null are left out.
    The sample goes by a hash of doc_id.  Without rows every probability is one
    half and no category holds.
    """
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    share = 1_000_000 * min(1.0, sample_rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    place = F.xxhash64("text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(np.array([s for w in distinct_words(t.as_py()) for s in slots_of(w)], np.int64)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int64())), *batch.columns[1:]], ["slots", "place", *categories]
            )

    # The sample is bounded, so it is sent to where the documents are.
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id")
    sample = sample.select("text", place.alias("place"), *categories)
    schema = ", ".join(["slots array<long>", "place long", *[f"{c} int" for c in categories]])
    found = sample.mapInArrow(features, schema).toArrow().sort_by([(c, "ascending") for c in ("place", *categories)]).combine_chunks()
    labels = np.column_stack([found.column(c).to_numpy() for c in categories]).reshape(-1, len(categories))
    lists = found.column("slots").combine_chunks()
    ends = lists.offsets.to_numpy()
    rows = np.split(lists.values.to_numpy(), ends[1:-1]) if len(labels) else []
    if not rows:
        zero = lambda k: Linear(np.zeros(SLOTS), np.zeros(k), 0.0)
        return Chain(categories, [zero(k) for k in range(len(categories))], [1.0] * len(categories))
    return fit_chain(rows, labels, categories)


class WordWeights(dict):
    """The sum of a word's weights in every model; forgets them all at a million words."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = self.table[slots_of(word)].sum(axis=0)
        return value


def predict_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and, for each category c, ``p_c`` (probability) and ``is_c`` (whether it holds) of each row's whole text.

    A null or empty text has no words: only the bias speaks, and nothing holds.
    """
    names = chain.categories
    table = np.stack([m.weights for m in chain.models], axis=1).astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast((table, [(m.earlier, m.bias) for m in chain.models], chain.thresholds))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rest, thresholds = held.value
        weights = WordWeights(table)
        for batch in batches:
            columns: list[list] = [[] for _ in range(2 * len(names))]
            for text in batch.column(1):
                words = distinct_words(text.as_py())
                sums = np.sum(list(map(weights.__getitem__, words)), axis=0) if words else np.zeros(len(names))
                before: list[float] = []
                for k, (earlier, bias) in enumerate(rest):
                    p = float(_logistic(np.float64(sums[k] + earlier @ np.array(before) + bias if before else sums[k] + bias)))
                    before.append(p)
                    columns[2 * k].append(p)
                    columns[2 * k + 1].append(bool(words) and p >= thresholds[k])
            kinds = [pa.float64(), pa.bool_()] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *[f"{a}_{c}" for c in names for a in ("p", "is")]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(predict, ", ".join(["doc_id long", *[f"p_{c} double, is_{c} boolean" for c in names]]))
