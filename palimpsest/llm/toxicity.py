"""Toxicity by a classifier chain: one logistic regression per category, in order.

A document's features are which words and word beginnings of a bounded vocabulary it holds, and which of them often;
every model after the first is also given the log-odds of the categories before it. A later model is trained on out-of-fold predictions
of the earlier ones, and predicts with the earlier models fitted to all training rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from palimpsest.llm.scratch import let_workers_import

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
LEVELS = (2, 4, 8)


def features_of(text: str | None) -> list[str]:
    """Words and word beginnings that occur, and those that occur at least 2, 4 and 8 times."""
    counts = Counter(WORDS.findall((text or "").lower()))
    begin: Counter[str] = Counter()
    for w, n in counts.items():
        for k in PREFIXES:
            if len(w) > k:
                begin[w[:k] + "*"] += n
    counts.update(begin)
    out = list(counts)
    for f, n in counts.items():
        if n >= LEVELS[0]:
            out.extend(f"{f}#{k}" for k in LEVELS if n >= k)
    return out


@dataclass
class Linear:
    weights: np.ndarray  # one per feature, then one per earlier category
    bias: float


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        rows = [[k for k in map(self.vocabulary.get, features_of(t)) if k is not None] for t in texts]
        starts, flat = _ragged(rows)
        given = np.zeros((len(texts), 0))
        for m in self.models:
            z = _scores(starts, flat, m.weights, given) + m.bias
            given = np.column_stack([given, z])
        return (1 + np.tanh(given / 2)) / 2


def _ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows], dtype=np.int64)
    return np.concatenate([[0], np.cumsum(n)]), np.fromiter((k for r in rows for k in sorted(r)), dtype=np.int64, count=int(n.sum()))


def _scores(starts: np.ndarray, flat: np.ndarray, weights: np.ndarray, given: np.ndarray) -> np.ndarray:
    words = len(weights) - given.shape[1]
    total = np.concatenate([[0.0], np.cumsum(weights[flat])])
    return total[starts[1:]] - total[starts[:-1]] + given @ weights[words:]


def fit_linear(starts: np.ndarray, flat: np.ndarray, given: np.ndarray, y: np.ndarray, words: int, ridge: float = 0.3, tolerance: float = 1e-3, most: int = 1000) -> Linear:
    """Logistic regression with an L2 penalty, by L-BFGS over columns scaled by their counts; the bias is free.

    It ends where the gradient has fallen to `tolerance` of its first norm; `most` is a guard against rounding only.
    """
    n, size = len(y), words + given.shape[1]
    weights, bias = np.zeros(size), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if not 0 < y.sum() < n:
        return Linear(weights, bias)  # one class only: nothing to tell apart, and a free bias would run away
    row = np.repeat(np.arange(n), np.diff(starts))
    seen = np.concatenate([np.bincount(flat, minlength=words), (given * given).sum(axis=0)])
    rare = min(y.mean(), 1 - y.mean())
    scale = 1 / np.sqrt(np.concatenate([seen * rare * (1 - rare) + ridge, [n * rare * (1 - rare)]]))

    def loss(u: np.ndarray) -> tuple[float, np.ndarray]:
        x = u * scale
        z = _scores(starts, flat, x[:-1], given) + x[-1]
        g = (1 + np.tanh(z / 2)) / 2 - y
        slope = np.concatenate([np.bincount(flat, weights=g[row], minlength=words), given.T @ g]) + ridge * x[:-1]
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * (x[:-1] @ x[:-1])), np.append(slope, g.sum()) * scale

    u = np.append(weights, bias / scale[-1])
    f, g = loss(u)
    goal = tolerance * np.linalg.norm(g)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        if np.linalg.norm(g) <= goal:
            break
        d, kept = -g, []
        for s, v in reversed(past):
            kept.append((s @ d) / (s @ v))
            d = d - kept[-1] * v
        if past:
            s, v = past[-1]
            d = d * ((s @ v) / (v @ v))
        for (s, v), a in zip(past, reversed(kept)):
            d = d + (a - (v @ d) / (s @ v)) * s
        step = 1.0
        while step > 1e-8:
            f1, g1 = loss(u + step * d)
            if f1 <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, v = step * d, g1 - g
        u, f, g = u + s, f1, g1
        if s @ v > 1e-12:
            past = [*past[-9:], (s, v)]
    return Linear((u * scale)[:-1], float((u * scale)[-1]))


def _part(starts: np.ndarray, flat: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(starts)[take]
    to = np.concatenate([[0], np.cumsum(n)])
    return to, flat[np.repeat(starts[take] - to[:-1], n) + np.arange(to[-1])]


def train(texts: list[str], labels: np.ndarray, categories: list[str], folds: int = 3, least: int = 4, vocabulary: int = 50_000) -> Chain:
    """labels: a row per text, a column per category, 0 or 1. Each threshold is the out-of-fold best by F1.

    Features of fewer than `least` texts are left out; frequent ones stay, however large a share of the texts holds them.
    """
    ids: dict[str, int] = {}
    held = [np.array([ids.setdefault(f, len(ids)) for f in features_of(t)], dtype=np.int64) for t in texts]
    df = np.bincount(np.concatenate(held), minlength=len(ids)) if ids else np.zeros(0, dtype=np.int64)
    kept = sorted((f for f, k in ids.items() if df[k] >= least), key=lambda f: (-df[ids[f]], f))[:vocabulary]
    place = {f: k for k, f in enumerate(kept)}
    new = np.full(len(ids), -1, dtype=np.int64)
    new[[ids[f] for f in kept]] = np.arange(len(kept))
    del ids
    starts, flat = _ragged([[k for k in new[h].tolist() if k >= 0] for h in held])
    fold = np.arange(len(texts)) % folds
    given, models, thresholds = np.zeros((len(texts), 0)), [], []
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        out = np.zeros(len(texts))
        for f in range(folds):
            to, of = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(to) or not len(of):
                continue
            m = fit_linear(*_part(starts, flat, to), given[to], y[to], len(kept))
            out[of] = _scores(*_part(starts, flat, of), m.weights, given[of]) + m.bias
        models.append(fit_linear(starts, flat, given, y, len(kept)))
        thresholds.append(_best_f1(out, y))
        given = np.column_stack([given, out])
    return Chain(categories, place, models, thresholds)


def _best_f1(z: np.ndarray, y: np.ndarray) -> float:
    """The probability of the best F1 by log-odds z: half-way from the least score accepted to the next one below."""
    best, at = -1.0, 0.0
    for t in np.unique(z[y > 0]):  # between two of these only false alarms change
        hit = z >= t
        f1 = 2 * (hit & (y > 0)).sum() / (hit.sum() + y.sum())
        if f1 > best + 1e-12:
            best, at = f1, float((t + z[~hit].max(initial=t - 1 if hit.all() else -np.inf)) / 2)
    return float((1 + np.tanh(at / 2)) / 2)


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, categories: dict[str, str], sample: int = 6000, sample_bytes: int = 256 << 20, seed: int = 23) -> Chain | None:
    """A chain over `categories` (name: SQL over labels' columns), in their order; None without labelled rows.

    Bounded: the `sample` labelled keys of the least hashes, and of their documents, in that order, those whose texts
    come to `sample_bytes` together. Rows with a null category, key or text are left out.
    """
    names = list(categories)
    rows = labels.select(F.col(key).alias("k"), *[F.expr(e).cast("int").alias(f"c{i}") for i, e in enumerate(categories.values())]).dropna()
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "k"), *rows.columns).limit(sample)
    taken = docs.select(F.col(key).alias("dk"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(rows), F.col("dk") == F.col("k")).orderBy(F.xxhash64("k", "t"), "t").limit(sample)
    before = F.sum(F.octet_length("t")).over(Window.orderBy(F.xxhash64("k", "t"), "t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = taken.withColumn("_bytes", before).where(F.col("_bytes") <= sample_bytes).collect()
    if not taken:
        return None
    return train([r["t"] for r in taken], np.array([[r[f"c{i}"] for i in range(len(names))] for r in taken]), names)


def score(docs: DataFrame, chain: Chain | None, key: str, text: str) -> DataFrame:
    """(key, p_<category>..., is_<category>...): one row per row of docs.

    A null or empty text has no features and gets the models' biases. Without a chain there are no category columns.
    A probability that ties with the threshold counts as the category. Texts are read whole, however long. Keys may be
    null or repeat; equal texts get equal results; extra columns are ignored; an empty table gives an empty result.
    """
    let_workers_import(docs.sparkSession)
    names = chain.categories if chain else []
    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField(key, base.schema["k"].dataType), *[T.StructField(f"p_{n}", T.DoubleType()) for n in names], *[T.StructField(f"is_{n}", T.BooleanType()) for n in names]])
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most 50,000 features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            p = c.probabilities(b.column(1).to_pylist()) if c else np.zeros((b.num_rows, 0))
            cols = [pa.array(np.round(p[:, k], 9)) for k in range(len(names))] + [pa.array(p[:, k] >= c.thresholds[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=schema.names)

    return base.mapInArrow(run, schema)
