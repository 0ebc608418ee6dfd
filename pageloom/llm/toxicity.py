"""Toxicity by compression distance to zstandard dictionaries.

Windows are of two kinds, each with a pair of dictionaries: runs of ``RUN``
tokens (whatever stands between blanks, so digits and signs too), one starting
every ``STEP`` tokens, and single words of letters.  Of a pair, one dictionary
is trained on toxic texts, the other on ordinary ones.  A window's distance is the number of bytes that the
ordinary dictionary needs beyond what the toxic one needs.  A fixed carrier
phrase, held by both dictionaries, follows each window: zstandard stores
inputs of a few bytes as they are and finds no match in the last eight.

The runs' dictionaries are trained on the whole texts.  Toxic words to train
on are those that contain a fragment (4 to 9 characters) significantly more
frequent in toxic documents.  A document's features are, for each kind, its
largest distances and the number of windows beyond a threshold; labelled rows
that the dictionaries have not seen set the thresholds and calibrate a
logistic curve that turns the features into a score.

``fit`` learns from a bounded sample (``TOXIC`` and ``ORDINARY`` documents at
most, of at most ``common.LONGEST`` characters) without fold 0, each weighed by
the labelled documents it stands for; a dictionary of words is trained on
``SAMPLES`` words at most, each at most ``REPEATS`` times; everything else
covers all rows and whole texts.

Rows: a null, empty or blank text has no window and gets the curve's value
there; repeated rows are scored alike; without labels of both
classes every score is 0; other columns are carried, but for those named
like a result; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import pickle
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common

#: Bounds of the sample to learn from.
TOXIC, ORDINARY = 1600, 3200
WINDOW = re.compile(r"[^\W\d_]+")
#: Tokens of a running window, and from one window's start to the next's; longer tokens (no blanks) are cut.
RUN, STEP = 8, 4
TOKEN = re.compile(r"\S{1,24}")
CARRIER = b"=a carrier phrase that stands behind each window="
#: Bounds of what a dictionary of words is trained on: repeats of a word, and samples.
REPEATS, SAMPLES = 50, 200_000
#: Windows whose distances a worker keeps.
KEPT = 200_000


def windows(text: str) -> set[str]:
    return set(WINDOW.findall(text.lower()))


def runs(text: str) -> set[str]:
    """Overlapping windows; any ``STEP + 1`` consecutive tokens lie in one."""
    tokens = TOKEN.findall(text.lower())
    return {" ".join(tokens[i : i + RUN]) for i in range(0, max(len(tokens) - STEP, min(len(tokens), 1)), STEP)}


def fragments(word: str) -> set[str]:
    own = f" {word} "
    return {own[i : i + n] for n in range(4, 10) for i in range(len(own) - n + 1)}


def significance(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio of ``a`` of ``n`` against ``b`` of ``m``."""

    def part(k, of, p):
        return (k * math.log(p) if k else 0) + ((of - k) * math.log(1 - p) if of - k else 0)

    both = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both))


class Words:
    """Distinct words of the texts to learn from, with the numbers of their fragments."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def coded(self, text: str) -> np.ndarray:
        """Numbers of the distinct words of a text."""
        own = windows(text)
        return np.fromiter((self.number.setdefault(w, len(self.number)) for w in own), np.int64, len(own))

    def closed(self) -> None:
        """Numbers the fragments of all words so far."""
        own = [np.fromiter(map(hash, fragments(w)), np.int64) for w in self.number]
        self.ends = np.cumsum([0] + [len(x) for x in own])
        distinct, self.fragment = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_inverse=True)
        self.kinds = len(distinct)

    def frequency(self, docs: list[np.ndarray]) -> np.ndarray:
        """Documents that hold each fragment."""
        out = np.zeros(self.kinds, np.int64)
        for doc in docs:
            if len(doc):
                out[np.unique(np.concatenate([self.fragment[self.ends[w] : self.ends[w + 1]] for w in doc.tolist()]))] += 1
        return out

    def counts(self, docs: list[np.ndarray], chosen: np.ndarray | None = None) -> dict[str, int]:
        """Documents that hold each word, of the ``chosen`` ones."""
        n = np.bincount(np.concatenate([*docs, np.zeros(0, np.int64)]), minlength=len(self.number))
        return {w: int(n[i]) for w, i in self.number.items() if n[i] and (chosen is None or chosen[i])}


def telling(words: Words, toxic: list[np.ndarray], ordinary: list[np.ndarray], ratio: float = 1.0) -> np.ndarray:
    """Whether each word has a fragment that marks toxic documents; an ordinary document stands for ``ratio`` times as many as a toxic one."""
    own, other, n, m = words.frequency(toxic), words.frequency(ordinary), len(toxic), len(ordinary)
    able = (own >= 3) & (own / n > 1.5 * other / m) & ((own + 0.5) / (own + ratio * other + 1) > 0.6)
    marks = np.zeros(words.kinds, bool)
    for f in np.flatnonzero(able).tolist():
        marks[f] = significance(int(own[f]), n, int(other[f]), m) > 24
    return np.array([marks[words.fragment[a:b]].any() for a, b in zip(words.ends[:-1], words.ends[1:], strict=True)], bool)


def dictionary(counts: dict[str, int], size: int, group: int, k: int) -> bytes:
    """Content of a dictionary trained on groups of windows, each as often as it occurs (``REPEATS`` times at most)."""
    samples = [f" {w} ".encode() for w, n in sorted(counts.items()) for _ in range(min(n, REPEATS))]
    random.Random(1).shuffle(samples)
    samples = samples[:SAMPLES]
    try:
        content = zstandard.train_dictionary(size, [b"".join(samples[i : i + group]) for i in range(0, len(samples), group)], k=k, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself
        content = b"".join(dict.fromkeys(samples))[-size:]
    return content + CARRIER


def running(texts: list[str], size: int, piece: int = 600) -> bytes:
    """Content of a dictionary trained on whole texts."""
    plain = [" ".join(TOKEN.findall(t.lower())).encode("utf-8", "replace") for t in texts]
    samples = [b" " + t[i : i + piece] + b" " for t in plain for i in range(0, len(t), piece)]
    random.Random(1).shuffle(samples)
    try:
        content = zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(dict.fromkeys(samples))[-size:]
    return content + CARRIER


class Distance:
    """Of one kind of windows, those that ``split`` finds in a text."""

    def __init__(self, toxic: bytes, ordinary: bytes, split=windows, keep: bool = True, search: tuple[int, int] = (zstandard.STRATEGY_LAZY2, 6)):
        self.split, self.keep, self.search = split, keep, search
        self.contents = toxic, ordinary
        self.pair = [self._compressor(c) for c in self.contents]
        self.known: dict[str, int] = {}

    def _compressor(self, content: bytes):
        strategy, depth = self.search
        params = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=17, hash_log=17, search_log=depth, min_match=4, target_length=64, strategy=strategy, write_content_size=False, write_dict_id=False
        )
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)

    def measured(self, own: list[str]) -> list[int]:
        """Bytes that the toxic dictionary saves on each window."""
        toxic, ordinary = (c.compress for c in self.pair)
        plain = [f" {w} ".encode("utf-8", "replace") + CARRIER for w in own]
        return [len(ordinary(d)) - len(toxic(d)) for d in plain]

    def found(self, text: str) -> list[int]:
        """Distances of all windows, largest first."""
        own = self.split(text)
        if not self.keep:
            return sorted(self.measured(list(own)), reverse=True)
        known = self.known
        out = [known[w] for w in own if w in known]
        if len(out) < len(own):
            missing = [w for w in own if w not in known]
            more = self.measured(missing)
            if len(known) + len(missing) > KEPT:
                known.clear()
            known.update(zip(missing, more, strict=True))
            out += more
        return sorted(out, reverse=True)


def pairs(contents: tuple) -> tuple[Distance, Distance]:
    """Distances of words and of runs; runs seldom come again, so they are not kept and compressed at less than half the cost."""
    return Distance(*contents[:2]), Distance(*contents[2:], split=runs, keep=False, search=(zstandard.STRATEGY_GREEDY, 3))


def beyond(found: list[int], least: int) -> float:
    return math.log1p(sum(d >= least for d in found))


def features(words: list[int], phrases: list[int], least: tuple[int, int]) -> list[float]:
    out = [1.0]
    for found, t in zip((words, phrases), least, strict=True):
        top = (found[:4] + [-6] * 4)[:4]
        out += [top[0], top[1], sum(top) / 4, beyond(found, t), math.log1p(len(found))]
    return out


def threshold(lists: list[list[int]], y: np.ndarray, weight: np.ndarray) -> int:
    """The distance from which on the number of windows tells the classes apart best."""

    def loss(t: int) -> float:
        x = np.array([[1.0, beyond(found, t)] for found in lists])
        p = 1 / (1 + np.exp(-np.clip(x @ logistic(x, y, weight), -30, 30)))
        return -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    return min(range(1, 25), key=loss)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Coefficients by Newton's method on weighted rows."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_rows(rows: list[tuple[str, int, float]]) -> bytes:
    """A model from (text, label, weight) rows; two thirds train the dictionaries, the rest the thresholds and the curve."""
    train, rest = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    words = Words()
    toxic, ordinary = ([words.coded(t) for t, y, _ in train if y == c] for c in (1, 0))
    if not toxic or not ordinary or len({y for _, y, _ in rest}) < 2:
        return pickle.dumps(None)
    words.closed()
    by_class = {y: w for _, y, w in rows}
    own = words.counts(toxic, telling(words, toxic, ordinary, by_class[0] / by_class[1]))
    contents = dictionary(own, 16384, 8, 24), dictionary(words.counts(ordinary), 65536, 16, 48)
    del words, toxic, ordinary
    contents += tuple(running([t for t, y, _ in train if y == c], 65536) for c in (1, 0))
    found = [[d.found(t) for t, *_ in rest] for d in pairs(contents)]
    y, weight = np.array([y for _, y, _ in rest], float), np.array([w for *_, w in rest])
    weight /= weight.mean()
    least = tuple(threshold(lists, y, weight) for lists in found)
    weights = logistic(np.array([features(*both, least) for both in zip(*found, strict=True)]), y, weight)
    return pickle.dumps((contents, least, weights.tolist()))


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    rows = common.labelled(docs, labels, "toxic", {1: TOXIC, 0: ORDINARY})
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([(r["text"], r["label"], r["weight"]) for r in rows])

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fit_rows(shared.value)], pa.binary())], ["model"])

    return bytes(spark.range(0, 1, 1, 1).mapInArrow(run, "model binary").first()["model"])  # in a task: more memory than a driver has


@lru_cache(maxsize=2)
def loaded(model: bytes):
    got = pickle.loads(model)
    return got and (pairs(got[0]), got[1], np.array(got[2]))


def score_texts(model: bytes, texts: list[str]) -> np.ndarray:
    got = loaded(model)
    if got is None:
        return np.zeros(len(texts))
    (words, phrases), least, weights = got
    rows = [features(words.found(t), phrases.found(t), least) for t in texts]
    return 1 / (1 + np.exp(-np.clip(np.array(rows).reshape(-1, len(weights)) @ weights, -30, 30)))


def score(docs: DataFrame, model: bytes, column: str = "score") -> DataFrame:
    """``docs`` with its columns and ``column``, the toxicity of each whole text."""
    docs, schema = common.extended(docs, **{column: "double"})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 20):
                values = score_texts(shared.value, [t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], [*part.schema.names, column])

    return docs.mapInArrow(run, schema)
