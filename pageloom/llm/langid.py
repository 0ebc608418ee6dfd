"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built from a bounded sample of
labelled text.  A text, its words of letters in lower case with one blank
between, is parsed from end to end into the longest phrases that occur in the
sample, across words; the language that needs the fewest phrases per
character, each weighed by the logarithm of its sample's length, wins.  Texts
are parsed side by side, one character of each at a step, against one hash
table of all automata's edges; a text longer than ``SEGMENT`` characters is
parsed in segments, all of which count.

``fit`` learns every labelled language, each from at most ``DOCUMENTS``
documents (whole texts) and ``CHARS`` characters, without fold 0; everything
else covers all rows and whole texts.  A worker holds ``TOGETHER`` automata;
with more languages the texts are passed once for each such group, and carry
the two least costs so far.

Rows: a null text, or one without a letter, is ``und`` with score 0; ties go
to the language that sorts first; repeated rows get the same answer; without
any learned language all are ``und``; other columns
are carried, but for those named like a result; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bounds of the sample to learn from, for each language.
DOCUMENTS, CHARS = 200, 60_000
#: Languages whose automata (some 5 MB each) a worker holds at once.
TOGETHER = 12
#: Characters parsed in one go, and characters whose texts are parsed side by side.
SEGMENT, BESIDE = 4096, 4 << 20
WORD = re.compile(r"[^\W\d_]+")
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """What is parsed of a text."""
    return " ".join(WORD.findall(text.lower()))


class Automaton:
    """All substrings of a text, as states with edges by character."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def parse(self, text: str) -> int:
        """Number of longest-match phrases; a character that the sample lacks is one of its own."""
        phrases, state, start, steps = 0, 0, self.next[0], self.next
        for c in text:
            nxt = steps[state].get(c)
            if nxt is None:
                phrases += state > 0
                nxt = start.get(c)
                if nxt is None:
                    phrases += 1
                    nxt = 0
            state = nxt
        return phrases + (state > 0)


class Edges:
    """Numbers below 2**``BITS`` by key, looked up for whole arrays: open addressing with linear probing.

    A slot holds the key and, in its low bits, the number; an empty one 0.
    """

    BITS = 22

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.held = np.zeros(1 << bits, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.held[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.held[slot[own]] = (keys[own] << self.BITS) | values[own]
            left = np.setdiff1d(left, own, assume_unique=True)
            taken = self.held[slot[left]] != 0
            slot[left[taken]] = (slot[left[taken]] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, 0 where there is none."""
        slot = self._slot(keys)
        got = self.held[slot]
        apart = (got >> self.BITS) != keys
        open_ = np.flatnonzero(apart & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            own = self.held[slot[open_]]
            differ = (own >> self.BITS) != keys[open_]
            got[open_], apart[open_] = own, differ
            open_ = open_[differ & (own != 0)]
        got &= (1 << self.BITS) - 1
        got[apart] = 0
        return got


class Parser:
    """Cross-parses texts against the samples of all languages."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        characters = sorted(set().union(*samples.values()))
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.width = len(characters) + 1
        self.roots, self.start, self.weights = [], np.zeros((len(self.languages), self.width), np.int64), []
        keys, values, states = [], [], 1  # state 0 stands for no state
        for i, language in enumerate(self.languages):
            own = Automaton(samples[language]).next
            at = np.repeat(np.arange(len(own)), [len(x) for x in own]) + states
            codes = self.code[np.fromiter((ord(c) for x in own for c in x), np.int64, len(at))]
            to = np.fromiter((n for x in own for n in x.values()), np.int64, len(at)) + states
            keys.append(at * self.width + codes)
            values.append(to)
            self.start[i, codes[at == states]] = to[at == states]
            self.roots.append(states)
            self.weights.append(math.log2(len(samples[language]) + 2))
            states += len(own)
        self.edges = Edges(np.concatenate(keys), np.concatenate(values))
        self.roots, self.weights = np.array(self.roots), np.array(self.weights)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language."""
        codes = self.code[np.frombuffer("".join([*texts, " "]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        lengths = np.array([len(t) for t in texts], np.int64)
        counts = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), counts)
        within = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * SEGMENT
        begin, size = (np.cumsum(lengths) - lengths)[owner] + within, np.minimum(lengths[owner] - within, SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        languages = len(self.languages)
        root = np.tile(self.roots, len(order))
        state, found, start = root.copy(), np.zeros(len(root), np.int64), self.start.ravel()
        row = np.tile(np.arange(languages) * self.width, len(order))
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        for i, k in enumerate((active * languages).tolist()):
            code = np.repeat(codes[begin[: k // languages] + i], languages)
            after = self.edges(state[:k] * self.width + code)
            stuck = np.flatnonzero(after == 0)
            if len(stuck):
                again = start[row[stuck] + code[stuck]]
                unknown = again == 0
                found[stuck] += (state[stuck] != root[stuck]).astype(np.int64) + unknown
                after[stuck] = np.where(unknown, root[stuck], again)
            state[:k] = after
        found = (found + (state != root)).reshape(-1, languages)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        np.add.at(out, owner, found)
        return out

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cost by character of each text in each language, and whether it has a letter."""
        texts = [plain(t) for t in texts]
        size = np.array([len(t) for t in texts])
        parts = np.flatnonzero(np.diff(np.cumsum(size) // BESIDE)) + 1
        found = [self.phrases(texts[a:b]) for a, b in zip([0, *parts], [*parts, len(texts)], strict=True)]
        return np.concatenate(found) * self.weights / np.maximum(size, 1)[:, None], size > 0

    def better(self, texts: list[str], names: list, first: np.ndarray, second: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """The cheapest language, its cost and the next cost, given those of the languages that sort before; and whether there is a letter."""
        rates, known = self.rates(texts)
        at = rates.argmin(axis=1)
        ordered = np.sort(np.concatenate([first[:, None], second[:, None], rates], axis=1), axis=1)
        here = rates[np.arange(len(texts)), at] < first
        return [self.languages[a] if h else n for a, h, n in zip(at, here, names, strict=True)], ordered[:, 0], ordered[:, 1], known


def fit(docs: DataFrame) -> bytes:
    """Samples by language, pickled."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (common.fold(F.col("doc_id")) != 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = own.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= DOCUMENTS).groupBy("lang").agg(F.collect_list("doc_id").alias("ids"))
    picked = common.written(ids.select("lang", F.explode("ids").alias("doc_id")), "sample")
    rows = docs.join(picked, ["doc_id", "lang"]).select("doc_id", "lang", "text").dropDuplicates(["doc_id", "lang"])

    def words(batches):
        for batch in batches:
            words = [plain(t)[:CHARS] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(words, pa.string())], ["doc_id", "lang", "text"])

    before = Window.partitionBy("lang").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.mapInArrow(words, rows.schema).withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).filter(F.col("at") < CHARS).collect()
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        have = samples.get(r["lang"], " ")
        samples[r["lang"]] = (have + r["text"] + " ")[:CHARS]
    return pickle.dumps({k: v for k, v in samples.items() if v.strip()})


_held: dict[bytes, Parser] = {}


def loaded(model: bytes) -> Parser:
    """A worker keeps the last group's automata alone."""
    if model not in _held:
        _held.clear()
        _held[model] = Parser(pickle.loads(model))
    return _held[model]


def identify(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with its columns, ``lang_pred`` and ``score``."""
    samples = pickle.loads(model)
    names = sorted(samples)
    groups = [{x: samples[x] for x in names[i : i + TOGETHER]} for i in range(0, len(names), TOGETHER)]
    if not groups:
        return docs.drop("lang_pred", "score").select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    own = None
    for i, group in enumerate(groups):
        last = own
        own = _passed(docs if last is None else last, group, first=i == 0, only=len(names) == 1, end=i + 1 == len(groups))
        if i + 1 < len(groups):
            own = common.written(own, "languages")
            if last is not None:
                common.dropped(last)
    return own


def _passed(docs: DataFrame, group: dict[str, str], first: bool, only: bool, end: bool) -> DataFrame:
    """``docs`` after one group: the cheapest language so far with its cost as ``score`` and the next cost; at the ``end`` the result."""
    state = ["lang_pred", "score"] + ["langid_next"] * (not end)
    out, schema = common.extended(docs if not first else docs.drop("langid_next"), **dict(zip(state, ("string", "double", "double"), strict=False)))
    if first:
        docs = out
    elif end:
        schema = common.extended(docs.drop("langid_next"), lang_pred="string", score="double")[1]
    plain = [f for f in schema.names if f not in state]
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(group))

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text", 2 << 20):
                n = part.num_rows
                have = ([None] * n, np.full(n, np.inf), np.full(n, np.inf)) if first else (part.column("lang_pred").to_pylist(), part.column("score").to_numpy(), part.column("langid_next").to_numpy())
                langs, cost, after, known = loaded(shared.value).better([t or "" for t in part.column("text").to_pylist()], *have)
                if end:
                    after = cost * 2 if only else after
                    langs = [x if k else "und" for x, k in zip(langs, known, strict=True)]
                    cost = np.where(known, after / np.maximum(cost + after, 1e-12), 0.0)
                new = [pa.array(langs, pa.string()), pa.array(cost, pa.float64()), pa.array(after, pa.float64())][: len(state)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in plain), *new], [*plain, *state])

    return docs.mapInArrow(run, schema)
