"""Operator 10: language identification by a byte convolutional network.

Filters of several widths run over the bytes (ASCII letters folded to lower case) of fixed-length windows, each filter's
maximum over the window goes through ReLU into a softmax. Trained in numpy on labelled text; applied to all windows of whole
texts in batches, the windows' log-probabilities are summed per document. A filter's response to bytes is a sum of table rows (the
first layer sees one-hot bytes), so pairs of bytes are looked up at once.

Defined cases: null and empty texts get a null language and probability; ties go to the first language in order of name; a null
label isn't trained on; with no labelled text every language is null; a text of any length is judged by all its windows; repeated rows are judged alike and trained
on once; ids may be null, repeated or of any type; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


@dataclass
class Network:
    classes: list[str]
    tables: list[np.ndarray]  # per width: [width, 256, FILTERS]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """Per width, lookup tables of two bytes at a time (of one byte for an odd rest)."""
        return [[(t[j][:, None] + t[j + 1][None]).reshape(65536, -1) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in self.tables]


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """The text's bytes in rows of size, the last one filled up with zeros (spaces don't end it: a window may cut a word)."""
    a = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    n = -(-len(a) // size)
    out = np.zeros((n, size), np.uint8)
    out.ravel()[: len(a)] = a
    return out


def forward(net: Network, pairs: list[list[np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Log-probabilities of the windows."""
    two = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
    pooled = []
    for width, tables in zip(WIDTHS, pairs):
        n = x.shape[1] - width + 1
        z = None
        for k, t in enumerate(tables):
            i = two[:, 2 * k : 2 * k + n] if len(t) == 65536 else x[:, 2 * k : 2 * k + n]
            z = np.take(t, i, axis=0) if z is None else np.add(z, np.take(t, i, axis=0), out=z)
        pooled.append(z.max(1))
    h = np.maximum(np.concatenate(pooled, 1) + net.bias, 0)
    y = h @ net.out + net.out_bias
    y -= y.max(1, keepdims=True)
    return y - np.log(np.exp(y).sum(1, keepdims=True))


def spread(w: np.ndarray, n: int) -> np.ndarray:
    """n of the windows, evenly over the text (all, if there are fewer)."""
    return w if len(w) <= n else w[np.linspace(0, len(w) - 1, n).astype(int)]


def train(rows: list[tuple[np.ndarray, str]], steps: int = 700, batch: int = 96, seed: int = 7) -> Network | None:
    """Adam on softmax cross-entropy; gradients go through the maxima only. rows: (windows of a text, language)."""
    classes = sorted({y for _, y in rows})
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []
    for w, label in rows:
        x.append(w)
        y += [classes.index(label)] * len(w)
    x, y = np.concatenate(x), np.array(y)
    by_class = [np.flatnonzero(y == k) for k in range(len(classes))]
    p = {f"t{w}": rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS}
    p |= {"bias": np.zeros(FILTERS * len(WIDTHS)), "out": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(classes))), "ob": np.zeros(len(classes))}
    moment, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(c, max(1, batch // len(classes))) for c in by_class])  # classes alike
        xb, yb = x[at], y[at]
        # a random cut, so that short texts are seen as well
        size = int(rng.integers(24, WINDOW + 1))
        xb = xb[:, :size]
        pooled, where = [], []
        for w in WIDTHS:
            n = size - w + 1
            z = sum(np.take(p[f"t{w}"][j], xb[:, j : j + n], axis=0) for j in range(w))
            i = z.argmax(1)
            where.append(i)
            pooled.append(np.take_along_axis(z, i[:, None], 1)[:, 0])
        a = np.concatenate(pooled, 1) + p["bias"]
        h = np.maximum(a, 0)
        s = h @ p["out"] + p["ob"]
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        s[np.arange(len(yb)), yb] -= 1
        s /= len(yb)
        g = {"out": h.T @ s, "ob": s.sum(0)}
        d = (s @ p["out"].T) * (a > 0)
        g["bias"] = d.sum(0)
        for k, w in enumerate(WIDTHS):
            dk, t = d[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(p[f"t{w}"])
            for j in range(w):
                byte = np.take_along_axis(xb, where[k] + j, 1)
                np.add.at(t[j], (byte, np.arange(FILTERS)[None]), dk)
            g[f"t{w}"] = t
        for k, v in g.items():
            moment[k] = 0.9 * moment[k] + 0.1 * v
            square[k] = 0.999 * square[k] + 0.001 * v * v
            p[k] -= 0.01 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    f = np.float32
    return Network(classes, [p[f"t{w}"].astype(f) for w in WIDTHS], p["bias"].astype(f), p["out"].astype(f), p["ob"].astype(f))


def judge(net: Network, pairs: list[list[np.ndarray]], texts: list[str | None], batch: int = 128) -> Iterator[tuple[str | None, float | None]]:
    """(language, probability) of each text, from all its windows; the probability is that of the mean window."""
    waiting, sizes = [], []

    def flush() -> Iterator[tuple[str | None, float | None]]:
        if waiting:
            x = np.concatenate(waiting)
            y = np.concatenate([forward(net, pairs, x[s : s + batch]) for s in range(0, len(x), batch)])
        start = 0
        for n in sizes:
            if not n:
                yield None, None
                continue
            mean = y[start : start + n].astype(np.float64).mean(0)
            start += n
            e = np.exp(mean - mean.max())
            yield net.classes[int(mean.argmax())], float(e.max() / e.sum())

    total = 0
    for t in texts:
        w = windows(t) if t else None
        sizes.append(0 if w is None else len(w))
        if w is not None:
            waiting.append(w)
            total += len(w)
        if total >= 8 * batch:
            yield from flush()
            waiting, sizes, total = [], [], 0
    yield from flush()


def fit(docs: DataFrame, label_col: str = "lang", train_rows: int = 3000, train_windows: int = 4) -> Network | None:
    """The network. train_rows bounds the labelled documents that it is fitted on (drawn by a hash of id, text and label), train_windows the windows of each."""
    labelled = docs.select("doc_id", "text", F.col(label_col).alias("label")).filter("label is not null and text <> ''")
    total = labelled.count()
    if not total:
        return None
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([spread(windows(t), train_windows).tobytes() for t in b.column(0).to_pylist()], pa.binary()), b.column(1)], ["windows", "label"])

    rows = common.drawn(labelled, train_rows, total, 3).select("text", "label").mapInArrow(cut, "windows binary, label string").collect()
    return train([(np.frombuffer(w, np.uint8).reshape(-1, WINDOW), y) for w, y in sorted((bytes(r[0]), r[1]) for r in rows)])


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, language, probability) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        pairs = net.pairs() if net else []
        for b in batches:
            texts = b.column(1).to_pylist()
            found = list(judge(net, pairs, texts)) if net else [(None, None)] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "language", "probability"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, language string, probability double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identify(docs, fit(docs))
