"""Toxicity by a classifier chain.

Categories are predicted in sequence; each has a logistic model on the presence of words, and
the probabilities of all earlier categories are further inputs.  While training, those inputs are
out-of-fold predictions, so a later model sees earlier probabilities as honest as it will when
scoring.  Words (runs of letters, ASCII lower case) are chosen per category by a chi-squared
score on the labelled sample; the threshold of each category maximises F1 on out-of-fold predictions.

Training uses at most `sample_rows` labelled documents (a documented parameter; by hash of the id,
so the same for any input order).  Scoring covers every document and whole texts.

Defined results: null or wordless text is scored on the intercept alone; documents whose id is
null or repeats are scored row by row; labels with null ids or null values aren't used; without usable
labels (or with one class only) a category's probability is its prior; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SYMBOL_LOWER, Hashes, slices

FOLDS = 5
FEATURES = 400
RARE = 4

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of letters."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    solid = LETTERS[data]
    edge = np.zeros(len(data), bool)
    edge[offs[:-1][offs[:-1] < len(data)]] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:]
    last[:-1] &= ~solid[1:] | edge[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offs, starts, "right") - 1, Hashes(data, SYMBOL_LOWER).of(starts, ends)


def presence(row: np.ndarray, h: np.ndarray, rows: int, vocabulary: np.ndarray) -> np.ndarray:
    """rows x vocabulary, 1 where a row has a word of the (sorted) vocabulary."""
    out = np.zeros((rows, len(vocabulary)), np.float32)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = vocabulary[at] == h
        out[row[hit], at[hit]] = 1
    return out


def choose_words(row: np.ndarray, h: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """The words whose presence is most associated with y, by chi-squared; sorted hashes."""
    word, inverse = np.unique(h, return_inverse=True)
    pair = np.unique(inverse.astype(np.int64) * len(y) + row)
    word_of, row_of = pair // len(y), pair % len(y)
    n1 = np.bincount(word_of, minlength=len(word)).astype(float)
    o = np.bincount(word_of, weights=y[row_of], minlength=len(word))
    total, pos = float(len(y)), float(y.sum())
    expect = n1 * pos / total
    spread = expect * (1 - pos / total) * np.maximum(1 - n1 / total, 1e-9)
    score = np.where((n1 >= RARE) & (spread > 0), (o - expect) ** 2 / np.maximum(spread, 1e-12), -1.0)
    order = np.lexsort((word, -score))[:count]
    return np.sort(word[order[score[order] > 0]])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (intercept last) by Newton steps on the ridge-penalised likelihood."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)
    w = np.zeros(x.shape[1])
    p0 = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
    w[-1] = np.log(p0 / (1 - p0))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    names: list[str]
    words: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
        earlier = np.zeros((rows, 0))
        for words, w in zip(self.words, self.weights, strict=True):
            x = np.concatenate([presence(row, h, rows, words), earlier], axis=1)
            earlier = np.concatenate([earlier, _apply(w, x)[:, None]], axis=1)
        return earlier


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap between neighbouring scores whose cut has the best F1; 0.5 without positives."""
    if not len(y) or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def train_chain(row: np.ndarray, h: np.ndarray, labels: dict[str, np.ndarray]) -> Chain:
    """labels: 0/1 a row, in chain order."""
    chain = Chain(list(labels))
    rows = len(next(iter(labels.values())))
    fold = np.arange(rows) % FOLDS
    earlier = np.zeros((rows, 0))  # out-of-fold
    for y in labels.values():
        y = y.astype(float)
        out = np.zeros(rows)
        for k in range(FOLDS):
            own = fold != k
            keep = own[row]
            compact = np.cumsum(own) - 1
            words = choose_words(compact[row[keep]], h[keep], y[own], FEATURES) if own.any() else h[:0]
            x = np.concatenate([presence(row, h, rows, words), earlier], axis=1)
            out[~own] = _apply(logistic(x[own], y[own]), x[~own])
        words = choose_words(row, h, y, FEATURES) if rows else h[:0]
        chain.words.append(words)
        chain.weights.append(logistic(np.concatenate([presence(row, h, rows, words), earlier], axis=1), y))
        chain.thresholds.append(best_threshold(out, y))
        earlier = np.concatenate([earlier, out[:, None]], axis=1)
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000) -> Chain:
    """categories: name -> SQL expression over the labels (0 or 1), in chain order."""
    wanted = labels.select(F.col(id_col).alias("i"), *[F.expr(x).cast("int").alias(f"y{k}") for k, x in enumerate(categories.values())]).dropna().dropDuplicates(["i"])
    wanted = wanted.orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(wanted), "i")  # at most sample_rows rows
    sample = sample.orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    marks = [f"y{k}" for k in range(len(categories))]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's different words, so that whole texts don't go to the driver."""
        for batch in batches:
            for i, j, data, offs in slices(batch.column(0)):
                row, h = word_hashes(data, offs)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                sets = [np.unique(h[a:z]).tobytes() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *[batch.column(k + 1).slice(i, j - i) for k in range(len(marks))]], ["words", *marks])

    table = sample.select("t", *marks).mapInArrow(distinct, "words binary" + "".join(f", {m} int" for m in marks)).toArrow()
    sets = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    h = np.concatenate([*sets, np.zeros(0, np.uint64)])
    return train_chain(row, h, {name: np.array(table[f"y{k}"].to_pylist(), np.int64) for k, name in enumerate(categories)})


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>..., <category>...) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *[f"p_{c}" for c in chain.names], *chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.array(chain.thresholds)
        for batch in batches:
            for i, j, data, offs in slices(batch.column(1)):
                row, h = word_hashes(data, offs)
                p = chain.probabilities(row, h, j - i)
                flags = p >= cut
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(p[:, k].copy()) for k in range(p.shape[1])], *[pa.array(flags[:, k].copy()) for k in range(p.shape[1])]], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}" + "".join(f", p_{c} double" for c in chain.names) + "".join(f", {c} boolean" for c in chain.names))
