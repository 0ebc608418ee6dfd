"""Text quality by a factorisation machine.

Features are the hashed distinct words and signs of a text, statistics of its
structure in bins, and its length as the table's metadata give it.  The score
is logistic(w0 + sum w_i x_i + pairs), where the pairwise part
sum_{i<j} <v_i, v_j> x_i x_j is computed in linear time as half of
(sum v_i x_i)^2 - sum (v_i x_i)^2, by factor.

``fit`` learns from a bounded sample (``GOOD`` and ``POOR`` documents at most)
without fold 0, each weighed by the labelled documents it stands for;
everything else covers all rows and whole texts.

Rows: a null or empty text has only structure features; repeated rows are
scored alike; a null ``n_chars`` has a bin of its own; without labels every
score is 0.5; other columns are carried, but for those named
like a result; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Bounds of the sample to learn from.
GOOD, POOR = 3000, 2000
BUCKETS, FACTORS = 1 << 15, 8
TOKEN = re.compile(r"\w+|[^\w\s]+")
STATS, BINS = 9, 12
SIZE = BUCKETS + STATS * BINS


def structure(text: str, tokens: list[str], distinct: int, n_chars: int | None) -> list[int]:
    """Feature numbers of the binned statistics."""
    n, words = max(len(text), 1), max(len(tokens), 1)
    lines = text.count("\n") + 1
    signs = sum(not (t[0].isalnum() or t[0] == "_") for t in tokens)
    values = [
        math.log2(n),
        12 * distinct / words,
        24 * signs / words,
        len(text) / words,
        2 * math.log2(1 + len(text) / lines),
        math.log2(lines),
        40 * sum(map(text.count, "0123456789")) / n,
        12 * text.count(" ") / n * 5,
        0 if n_chars is None else 1 + math.log2(1 + max(n_chars, 0)) / 2,
    ]
    return [BUCKETS + k * BINS + min(BINS - 1, int(v * (0.6 if k == 0 else 1))) for k, v in enumerate(values)]


@lru_cache(maxsize=1 << 17)
def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


def features(texts: list[str], n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts, and each text's number of features.

    Word features have 1 / sqrt(number of distinct words), statistics 1 / 3.
    """
    index, value, lengths = [], [], []
    for text, n in zip(texts, n_chars, strict=True):
        tokens = TOKEN.findall(text.lower())
        own = set(tokens)
        stats = structure(text, tokens, len(own), n)
        index.extend(map(bucket, own))
        index.extend(stats)
        value.append(np.full(len(own), 1 / math.sqrt(max(len(own), 1))))
        value.append(np.full(len(stats), 1 / 3))
        lengths.append(len(own) + len(stats))
    return np.array(index, np.int64), np.concatenate(value) if value else np.zeros(0), np.array(lengths, np.int64)


def machine(w0: float, w: np.ndarray, v: np.ndarray, index, value, lengths) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic curve, and each text's sum of v_i x_i."""
    vx = v[index] * value[:, None]
    first, squares = common.sums(vx, lengths), common.sums((vx * vx).sum(axis=1), lengths)
    return w0 + common.sums(w[index] * value, lengths) + ((first**2).sum(axis=1) - squares) / 2, first


def fit_rows(rows: list[tuple[str, int | None, int, float]], epochs: int = 12, batch: int = 64, rate: float = 0.15, decay: float = 1e-4) -> bytes:
    """Adagrad on the weighted logistic loss of (text, n_chars, label, weight) rows."""
    rng = np.random.default_rng(5)
    w0, w, v = 0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, FACTORS))
    g0, gw, gv = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6)
    index, value, lengths = features([r[0] for r in rows], [r[1] for r in rows])
    begin, y = np.cumsum(lengths) - lengths, np.array([r[2] for r in rows], float)
    weight = np.array([r[3] for r in rows], float)
    if len(rows):
        weight /= weight.mean()
        share = np.clip((weight * y).mean(), 1e-6, 1 - 1e-6)
        w0 = math.log(share / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = order[at : at + batch]
            n = lengths[own]
            pick = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            i, x = index[pick], value[pick]
            out, first = machine(w0, w, v, i, x, n)
            error = weight[own] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[own])
            by_feature = np.repeat(error, n) * x
            used, where = np.unique(i, return_inverse=True)
            dw = np.bincount(where, by_feature, len(used)) / len(own) + decay * w[used]
            each = by_feature[:, None] * (np.repeat(first, n, axis=0) - v[i] * x[:, None])
            dv = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(FACTORS)], axis=1) / len(own) + decay * v[used]
            g0 += error.mean() ** 2
            gw[used] += dw**2
            gv[used] += dv**2
            w0 -= rate * error.mean() / math.sqrt(g0)
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
    return pickle.dumps((w0, w.astype(np.float32), v.astype(np.float32)))


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    rows = common.labelled(docs, labels, "quality", {1: GOOD, 0: POOR}, extra=("n_chars",))
    return fit_rows([(r["text"], r["n_chars"], r["label"], r["weight"]) for r in rows])


@lru_cache(maxsize=2)
def loaded(model: bytes):
    return pickle.loads(model)


def score_texts(model: bytes, texts: list[str], n_chars: list) -> np.ndarray:
    out, _ = machine(*loaded(model), *features(texts, n_chars))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` (with ``text`` and ``n_chars``) and the ``score`` of each whole text."""
    docs, schema = common.extended(docs, score="double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text", 2 << 20):
                values = score_texts(shared.value, [t or "" for t in part.column("text").to_pylist()], part.column("n_chars").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], [*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)
