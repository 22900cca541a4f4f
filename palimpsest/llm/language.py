"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is read as its words: maximal runs of letters, lower-cased, in UTF-8, in windows of at most `WINDOW` bytes with
a space on either side. The network labels every byte of a window, and a document's probabilities are the mean of its
positions' softmax outputs. A window is labelled alike wherever it stands, so a worker keeps the sums of the windows it
has seen, up to a fixed number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.llm.scratch import least_hashed, let_workers_import

WINDOW = 24
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def windows_of(text: str | None) -> list[bytes]:
    out = []
    for w in LETTERS.findall((text or "").lower()):
        b = w.encode("utf-8", "replace")
        out.extend((b,) if len(b) <= WINDOW else (b[k : k + WINDOW] for k in range(0, len(b), WINDOW)))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _bytes_matrix(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with a space on either side, padded with zeros, and each row's length."""
    n = np.array([len(w) + 2 for w in windows])
    x = np.zeros((len(windows), int(n.max())), dtype=np.int64)
    for k, w in enumerate(windows):
        x[k, : n[k]] = np.frombuffer(b" " + w + b" ", dtype=np.uint8)
    return x, n


@dataclass
class Direction:
    """One gated recurrent layer: a row of input weights per byte (update, reset, candidate), recurrent weights, biases."""

    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        rows, steps = x.shape
        h_size = self.wh.shape[0]
        h = np.zeros((rows, h_size), dtype=self.wh.dtype)
        out = np.empty((steps, rows, h_size), dtype=self.wh.dtype)
        tape = []
        table = self.wx + self.b
        for t in range(steps):
            g = table[x[:, t]]
            zr = _sigmoid(g[:, : 2 * h_size] + h @ self.wh[:, : 2 * h_size])
            z, r = zr[:, :h_size], zr[:, h_size:]
            c = np.tanh(g[:, 2 * h_size :] + (r * h) @ self.wh[:, 2 * h_size :])
            new = h + z * (c - h)
            if keep:
                tape.append((h, z, r, c))
            out[t] = h = new
        return out, tape

    def backward(self, x: np.ndarray, tape: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of wx, wh and b by backpropagation through time."""
        h_size = self.wh.shape[0]
        d_wx, d_wh = np.zeros_like(self.wx), np.zeros_like(self.wh)
        d_h = np.zeros_like(d_out[0])
        wz, wr, wc = (self.wh[:, k * h_size : (k + 1) * h_size] for k in range(3))
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, c = tape[t]
            d = d_h + d_out[t]
            d_c = d * z * (1 - c * c)
            d_rh = d_c @ wc.T
            d_z = d * (c - h) * z * (1 - z)
            d_r = d_rh * h * r * (1 - r)
            d_wh[:, :h_size] += h.T @ d_z
            d_wh[:, h_size : 2 * h_size] += h.T @ d_r
            d_wh[:, 2 * h_size :] += (r * h).T @ d_c
            np.add.at(d_wx, x[:, t], np.concatenate([d_z, d_r, d_c], axis=1))
            d_h = d * (1 - z) + d_rh * r + d_z @ wz.T + d_r @ wr.T
        return [d_wx, d_wh, d_wx.sum(axis=0)]


@dataclass
class Network:
    langs: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray

    def _reversed(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Index that turns each row's first n positions around and leaves its padding."""
        at = np.arange(x.shape[1])[None, :]
        return np.where(at < n[:, None], n[:, None] - 1 - at, at)

    def states(self, x: np.ndarray, n: np.ndarray, keep: bool = False):
        turn = self._reversed(x, n)
        fx = np.take_along_axis(x, turn, axis=1)
        a, tape_a = self.ahead.forward(x, keep)
        b, tape_b = self.back.forward(fx, keep)
        b = np.take_along_axis(b.transpose(1, 0, 2), turn[:, :, None], axis=1)
        return np.concatenate([a.transpose(1, 0, 2), b], axis=2), (turn, fx, tape_a, tape_b)

    def probabilities(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Softmax of every position, and which positions are no padding."""
        s, _ = self.states(x, n)
        return self._softmax(s), np.arange(x.shape[1])[None, :] < n[:, None]

    def _softmax(self, s: np.ndarray) -> np.ndarray:
        logits = s @ self.out + self.bias
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def window_sums(self, windows: list[bytes]) -> np.ndarray:
        """Each window's positions' probabilities summed; rows in the windows' order."""
        out = np.empty((len(windows), len(self.langs)))
        order = sorted(range(len(windows)), key=lambda k: len(windows[k]))
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            x, n = _bytes_matrix([windows[k] for k in part])
            p, real = self.probabilities(x, n)
            out[part] = (p * real[:, :, None]).sum(axis=1)
        return out


def train(windows: list[bytes], langs_of: list[str], hidden: int = 16, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 3) -> Network:
    """Cross entropy at every position, Adam, gradients by backpropagation through time. Same input, same network."""
    langs = sorted(set(langs_of))
    rng = np.random.default_rng(seed)
    f = np.float32

    def direction() -> Direction:
        return Direction(rng.normal(0, 0.3, (256, 3 * hidden)).astype(f), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(f), np.zeros(3 * hidden, dtype=f))

    net = Network(langs, direction(), direction(), rng.normal(0, 0.2, (2 * hidden, len(langs))).astype(f), np.zeros(len(langs), dtype=f))
    y = np.array([langs.index(x) for x in langs_of])
    params = [net.ahead.wx, net.ahead.wh, net.ahead.b, net.back.wx, net.back.wh, net.back.b, net.out, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x, n = _bytes_matrix([windows[k] for k in part])
            s, (turn, fx, tape_a, tape_b) = net.states(x, n, keep=True)
            p = net._softmax(s)
            real = (np.arange(x.shape[1])[None, :] < n[:, None]).astype(f)
            p[np.arange(len(part))[:, None], np.arange(x.shape[1])[None, :], y[part][:, None]] -= 1
            d = (p * real[:, :, None] / real.sum()).astype(f)
            flat, flat_s = d.reshape(-1, len(langs)), s.reshape(-1, 2 * hidden)
            d_s = d @ net.out.T
            d_b = np.take_along_axis(d_s[:, :, hidden:], turn[:, :, None], axis=1)
            grads = net.ahead.backward(x, tape_a, d_s[:, :, :hidden].transpose(1, 0, 2)) + net.back.backward(fx, tape_b, d_b.transpose(1, 0, 2))
            grads += [flat_s.T @ flat, flat.sum(axis=0)]
            step += 1
            for k, (q, g) in enumerate(zip(params, grads)):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                q -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, text: str, lang: str, sample_docs: int = 1500, sample_windows: int = 40_000, seed: int = 17) -> Network | None:
    """A network from docs' labelled rows; None if no row has a language and a letter.

    Bounded: the sample_docs different rows of the least hashes of their texts, and of those rows' different (language,
    window) pairs, weighted by occurrence, sample_windows. Languages come in the proportions of the sample.
    """
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    rows = least_hashed(rows, sample_docs, "t", "l", seed=seed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = windows_of(t)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(w), pa.string()), pa.array(w, pa.binary())], names=["l", "w"])

    counted = rows.mapInArrow(cut, T.StructType([T.StructField("l", T.StringType()), T.StructField("w", T.BinaryType())])).groupBy("l", "w").agg(F.count(F.lit(1)).alias("n"))
    # weighted sampling without replacement: the least of -log(u) / n
    u = (F.pmod(F.xxhash64(F.lit(seed), "l", "w"), F.lit(1 << 30)) + 1) / F.lit((1 << 30) + 2)
    taken = counted.orderBy(-F.log(u) / F.col("n"), "l", "w").limit(sample_windows).select("l", "w").collect()
    if not taken:
        return None
    return train([bytes(r["w"]) for r in taken], [r["l"] for r in taken])


class Labeller:
    """Document probabilities under a network, with the sums of windows seen before, at most `memo` of them."""

    def __init__(self, net: Network, memo: int = 300_000) -> None:
        self.net, self.memo = net, memo
        self.place: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(net.langs) + 1))

    def _look_up(self, windows: list[bytes]) -> np.ndarray:
        """Rows of sums and position counts, one per window."""
        at = list(map(self.place.get, windows))
        if None in at:
            new = list(dict.fromkeys(w for w, k in zip(windows, at) if k is None))
            if len(self.place) + len(new) > self.memo:
                self.place, self.sums = {}, self.sums[:0]
                new = list(dict.fromkeys(windows))
            rows = np.concatenate([self.net.window_sums(new), np.array([[len(w) + 2.0] for w in new])], axis=1)
            self.place.update(zip(new, range(len(self.sums), len(self.sums) + len(new))))
            self.sums = np.concatenate([self.sums, rows])
            at = list(map(self.place.__getitem__, windows))
        return self.sums[at]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        group: list[list[bytes]] = []
        held = 0
        for t in [*texts, ...]:
            if t is not ...:
                group.append(windows_of(t))
                held += len(group[-1])
            if held > 100_000 or t is ...:  # texts are whole; a group of them shares one look-up
                rows = self._look_up([w for ws in group for w in ws]) if held else None
                at = 0
                for ws in group:
                    if not ws:
                        langs.append(UNDETERMINED), scores.append(0.0)
                        continue
                    total = rows[at : at + len(ws)].sum(axis=0)
                    at += len(ws)
                    p = total[:-1] / total[-1]
                    langs.append(self.net.langs[int(p.argmax())]), scores.append(float(min(1.0, p.max())))
                group, held = [], 0
        return langs, scores


_LABELLERS: dict[str, Labeller] = {}


def identify(docs: DataFrame, net: Network | None, text: str, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with lang_col and score_col, which replace columns of those names.

    A text that is null or has no letter gets `und` and 0.0, and so does every text if net is None. Texts are read
    whole, however long; of languages that tie, the alphabetically first. Rows that repeat get equal results; other
    columns stay; an empty table gives an empty result.
    """
    import uuid

    let_workers_import(docs.sparkSession)
    name = uuid.uuid4().hex
    base = docs.drop(lang_col, score_col)
    schema = T.StructType([*base.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    at = base.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # 256 * 3 * hidden * 2 weights and some, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LABELLERS:
            _LABELLERS.clear()
            _LABELLERS[name] = Labeller(sent.value) if sent.value else None
        label = _LABELLERS[name]
        for b in batches:
            langs, scores = label(b.column(at).to_pylist()) if label else ([UNDETERMINED] * b.num_rows, [0.0] * b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return base.mapInArrow(run, schema)


def held_out(key: str) -> Column:
    """crc32 of the key as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
