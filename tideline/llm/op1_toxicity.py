"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. A later category's model sees, besides the words, the probabilities of
all earlier ones. It is trained on out-of-fold probabilities: those that earlier models, fitted without a row's fold,
give that row, so that it does not learn to trust predictions that saw the label.

Models are logistic regressions on the presence of words that score tests choose, so that the many words that say
nothing get no weight and a text's length does not tilt its score. They are fitted on a bounded sample of the labelled rows,
MAX_TRAIN of them at most, drawn by a hash of the id; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm._dist import small_batches
from tideline.llm._text import _TABLE, LOWER, U64, Block, Rolling, blocks, mix

MAX_TRAIN = 20_000
BITS = 18
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of each document, distinct and sorted, and the documents' bounds in them: words in lower case without
    punctuation at their ends, the punctuation that was cut there, whether capitals prevail, and how far words repeat."""
    words = block.words()
    start, stop = words.start.copy(), words.stop.copy()
    for _ in range(8):
        cut = (stop - start > 1) & _PUNCT[block.buf[np.maximum(stop - 1, 0)]] if len(stop) else np.zeros(0, bool)
        stop[cut] -= 1
        cut = (stop - start > 1) & _PUNCT[block.buf[start]] if len(start) else cut
        start[cut] += 1
    doc = words.doc()
    ids = Rolling(_TABLE[LOWER[block.buf]], 0x9E3779B97F4A7C17).hash(start, stop) >> U64(64 - BITS)
    ends = Rolling(_TABLE[block.buf], 0x9E3779B97F4A7C17).hash(stop, words.stop)
    tail = words.stop > stop
    ends = mix(ends[tail] ^ U64(77)) >> U64(64 - BITS)
    plain = doc * (1 << BITS) + ids.astype(np.int64)
    distinct = np.unique(plain)
    n = np.maximum(words.counts, 1)
    kinds = np.bincount(distinct >> BITS, minlength=len(n)) / n
    letters = np.concatenate(([0], np.cumsum((block.buf >= 65) & (block.buf <= 90))))
    capitals = (letters[block.offs[1:]] - letters[block.offs[:-1]]) / np.maximum(np.diff(block.offs), 1)
    at = np.arange(len(n)) * (1 << BITS)
    more = [at + (mix(U64(1000) + np.minimum(10 * v, 10).astype(U64) + U64(100 * j)) >> U64(64 - BITS)).astype(np.int64) for j, v in enumerate((kinds, capitals))]
    keys = np.unique(np.concatenate((distinct, doc[tail] * (1 << BITS) + ends.astype(np.int64), *more)))
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys >> BITS, np.arange(len(n) + 1))


@dataclass
class Rows:
    """A sparse binary matrix by rows."""

    ids: np.ndarray
    bounds: np.ndarray

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.ids], len(self.bounds) - 1)

    def only(self, keep: np.ndarray) -> Rows:
        """Rows where keep, in order."""
        inside = keep[self.row]
        return Rows(self.ids[inside], np.concatenate(([0], np.cumsum(np.diff(self.bounds)[keep]))))


@dataclass
class Linear:
    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, x: Rows, earlier: np.ndarray) -> np.ndarray:
        return _sigmoid(x.dot(self.words) + earlier @ self.earlier + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Rows, earlier: np.ndarray, y: np.ndarray, rounds: int = 10, step: int = 32, least_score: float = 3.5, ridge: float = 0.5) -> Linear:
    """Logistic regression on the words that score tests choose.

    Each round adds the words whose score statistic, given the model so far, is the largest (`step` at most, beyond
    `least_score` standard deviations, in three rows at least), and refits by Newton steps with a small ridge.
    """
    n, size, k = len(y), 1 << BITS, earlier.shape[1]
    words, dense = np.zeros(0, np.int64), np.concatenate((np.ones((n, 1)), earlier), 1)
    w = np.zeros(1 + k)
    seen = np.bincount(x.ids, minlength=size)
    for _ in range(rounds if n else 0):
        for _ in range(12):
            p = _sigmoid(dense @ w)
            hessian = dense.T @ (dense * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
            change = np.linalg.solve(hessian, dense.T @ (y - p) - ridge * w)
            w = w + change * min(1.0, 4 / max(1e-12, np.abs(change).max()))
            if np.abs(change).max() < 1e-4:
                break
        p = _sigmoid(dense @ w)
        gain = np.bincount(x.ids, (y - p)[x.row], size)
        spread = np.bincount(x.ids, (p * (1 - p))[x.row], size)
        score = np.where(seen >= 3, np.abs(gain) / np.sqrt(spread + 0.05), 0)
        score[words] = 0
        new = np.argsort(-score, kind="stable")[:step]
        new = new[score[new] >= least_score]
        if not len(new):
            break
        place = np.full(size, -1)
        place[new] = np.arange(len(new))
        columns = np.zeros((n, len(new)))
        at = place[x.ids] >= 0
        columns[x.row[at], place[x.ids[at]]] = 1
        dense, words, w = np.concatenate((dense, columns), 1), np.concatenate((words, new)), np.concatenate((w, np.zeros(len(new))))
    full = np.zeros(size)
    full[words] = w[1 + k : 1 + k + len(words)]
    return Linear(full, w[1 : 1 + k], float(w[0]))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear] = field(default_factory=list)

    def predict(self, x: Rows) -> np.ndarray:
        """Probabilities, one column for each category; each model sees those before it."""
        n = len(x.bounds) - 1
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.concatenate((out, model.predict(x, out)[:, None]), 1)
        return out


def fit_chain(x: Rows, y: np.ndarray, names: Sequence[str], fold: np.ndarray, folds: int = 4) -> Chain:
    """y: one column for each category, NaN where there is no label; fold: the fold of each row."""
    chain, out_of_fold = Chain(list(names)), np.zeros((len(y), 0))
    for j in range(y.shape[1]):
        known = ~np.isnan(y[:, j])
        held = np.zeros(len(y))
        for f in range(folds):
            train, test = known & (fold != f), fold == f
            if test.any():
                model = fit_linear(x.only(train), out_of_fold[train], y[train, j])
                held[test] = model.predict(x.only(test), out_of_fold[test])
        chain.models.append(fit_linear(x.only(known), out_of_fold[known], y[known, j]))
        out_of_fold = np.concatenate((out_of_fold, held[:, None]), 1)
    return chain


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            ids, bounds = word_features(block)
            packed = pa.array([ids[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(block.ids))], pa.binary())
            rest = batch.slice(block.first, len(block.ids)).drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, packed], names=[*rest.schema.names, "features"])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_train: int = MAX_TRAIN, folds: int = 4) -> Chain:
    """A chain over the categories, in their order; each is a column over labels: 1, 0 or null. Rows with null ids, and
    labels without a document, take no part; a repeated label counts each time."""
    small_batches(docs.sparkSession)
    sample = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), *[c.cast("double").alias(f"y{i}") for i, c in enumerate(categories.values())])
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(max_train)  # max_train rows of a few numbers: bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).drop("_id")
    kept = "doc_id long, " + ", ".join(f"y{i} double" for i in range(len(categories)))
    table = rows.select("doc_id", *[f"y{i}" for i in range(len(categories))], "text").mapInArrow(_features, f"{kept}, features binary").toArrow()
    ids = np.asarray(table.column("doc_id")).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    table, ids = table.take(pa.array(order)), ids[order]
    parts = [np.frombuffer(x, np.int32) for x in table.column("features").to_pylist()]
    x = Rows(np.concatenate([*parts, np.zeros(0, np.int32)]), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64))
    y = np.array([table.column(f"y{i}").to_pylist() for i in range(len(categories))], float).T.reshape(len(ids), len(categories))
    return fit_chain(x, y, list(categories), (mix(ids.astype(U64) + U64(12345)) % U64(folds)).astype(np.int64), folds)


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> for every row with a doc_id. Takes doc_id and text; other columns are not looked at. Null and
    empty texts get what the models give to a text without words; repeated rows repeat the result. The model that goes
    to the executors has a fixed size."""
    small_batches(docs.sparkSession)
    names = [f"p_{n}" for n in chain.names]
    models = [(np.flatnonzero(m.words).astype(np.int32), m.words[np.flatnonzero(m.words)], m.earlier, m.bias) for m in chain.models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = Chain(names)
        for at, values, earlier, bias in models:
            w = np.zeros(1 << BITS)
            w[at] = values
            full.models.append(Linear(w, earlier, bias))
        for batch in batches:
            for block in blocks(batch):
                p = full.predict(Rows(*word_features(block)))
                yield pa.RecordBatch.from_arrays([pa.array(block.ids), *[pa.array(np.ascontiguousarray(p[:, j])) for j in range(len(names))]], names=["doc_id", *names])

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    # Text of low quality looks unlike other text, so that category comes first in the chain.
    chain = train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return predict(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)
