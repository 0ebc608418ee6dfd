"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

A merge list with word ends is compiled once per Python worker.  From the list
follows ``lookahead``: the number of symbols to the right of a token after
which nothing that arrives later can change that token.  Every word goes
through a window of ``window`` symbols, more than twice the lookahead: it is
filled, merged, and gives off the tokens that are stable, or all once the word
has ended.  The windows of a portion's distinct words are rows of one matrix,
merged together, one merge a row and round.  Texts pass in portions of about
``PORTION`` characters, so that working memory does not grow with a text; only
the ids, which are the result, do.

Decoding looks the ids up in the vocabulary and runs their bytes through an
incremental UTF-8 decoder.

Rows: a null text counts as empty and has no ids; ties between equal merges go
to the leftmost pair; repeated rows and ids are kept; extra columns of the
input are not carried, whatever their names; an empty table gives an empty
table.
"""

from __future__ import annotations

import bisect
import codecs
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

NONE = np.int32(2**31 - 1)
#: Characters that any version of Unicode classes and puts in lower case alike, one by one.
PLAIN = re.compile(r"[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]*\Z")
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+(?:_|[^\s\w])*|_(?:_|[^\s\w])*")
#: Characters of text whose words are encoded together.
PORTION = 1 << 18
#: Distinct words whose ids a worker keeps.
KEPT = 200_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """A compiled merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.size = len(self.names)
        symbols = byte_symbols()
        self.byte = {c: b for b, c in symbols.items()}
        self.library = Tokenizer.from_file(path)
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[symbols[b] + end] for b in range(256)], np.int32)
        triples = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            triples.append((vocab[left], vocab[right], vocab[left + right]))
        self.triples = triples
        left, right, made = (np.array(x, np.int64) for x in zip(*triples, strict=True))
        order = np.argsort(left * self.size + right)
        self.keys = (left * self.size + right)[order]
        self.ranks = np.arange(len(triples), dtype=np.int32)[order]
        self.made = made.astype(np.int32)
        self.lookahead = self._lookahead()
        self.cache: dict[str, tuple[int, ...]] = {}
        marks = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = re.compile(f"({marks})") if marks else None

    def _lookahead(self) -> int:
        """Symbols to the right of a token that can still change it.

        A merge of (u, v) is undone from the right only by an earlier merge
        that takes v, or a token on v's right edge before v was made, as its
        left part.  That one needs its own right part and whatever can undo it
        in turn.  Ranks fall along such a chain, so it is found in rank order.
        """
        length = {i: 1 for i in [*self.inner.tolist(), *self.last.tolist()]}
        parts: dict[int, tuple[int, int]] = {}
        ranks: dict[int, list[int]] = {}
        needs: dict[int, list[int]] = {}
        most = 0
        for rank, (u, v, w) in enumerate(self.triples):
            length.setdefault(w, length.get(u, 1) + length.get(v, 1))
            need, token, before = 0, v, rank
            while True:
                at = bisect.bisect_left(ranks.get(token, ()), before)
                if at:
                    need = max(need, needs[token][at - 1])
                if token not in parts:
                    break
                before, token = parts[token]
            reach = length.get(v, 1) + need
            ranks.setdefault(u, []).append(rank)
            needs.setdefault(u, []).append(max(reach, needs[u][-1] if needs.get(u) else 0))
            parts.setdefault(w, (rank, v))
            most = max(most, reach)
        return most

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Apply the list to each row of symbols (-1: no symbol), lowest rank first, leftmost first."""
        rows = np.concatenate([rows, np.full((len(rows), 1), -1, np.int32)], axis=1)
        width = rows.shape[1]
        ranks = self.pair_ranks(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), width - 1)
        out = np.full((len(rows), width), -1, np.int32)
        at = np.arange(len(rows))
        columns = np.arange(width - 1)
        while len(rows):
            best = ranks.min(axis=1)
            done = best == NONE
            if done.any():
                out[at[done]] = rows[done]
                live = ~done
                rows, ranks, at, best = rows[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            where = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            rows[each, where] = self.made[best]
            from_right = columns[None, :] > where[:, None]
            rows[:, :-1] = np.where(from_right, rows[:, 1:], rows[:, :-1])
            rows[:, -1] = -1
            ranks[:, :-1] = np.where(from_right[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            ranks[each, where] = self.pair_ranks(rows[each, where], rows[each, where + 1])
            inner = where > 0
            left = each[inner], where[inner] - 1
            ranks[left] = self.pair_ranks(rows[left], rows[left[0], left[1] + 1])
        return out

    @property
    def window(self) -> int:
        """Symbols of a word that are held at a time: some token is stable in any full window."""
        return 2 * self.lookahead + 2

    def stream(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, emitted as soon as they are stable."""
        out: list[list[int]] = [[] for _ in words]
        held = [(i, np.zeros(0, np.int32), 0) for i in range(len(words))]
        while held:
            by_width: dict[int, list[tuple]] = {}
            for i, rest, fed in held:
                part = np.frombuffer(words[i], np.uint8, offset=fed)[: self.window - len(rest)] if fed < len(words[i]) else np.zeros(0, np.uint8)
                symbols = self.inner[part]
                fed += len(part)
                if len(part) and fed == len(words[i]):
                    symbols[-1] = self.last[part[-1]]
                symbols = np.concatenate([rest, symbols]) if len(rest) else symbols
                by_width.setdefault(-(-len(symbols) // 4) * 4, []).append((i, symbols, fed))
            held = []
            for width, rows in by_width.items():
                lengths = np.array([len(x) for _, x, _ in rows])
                matrix = np.full((len(rows), width), -1, np.int32)
                matrix[np.arange(width) < lengths[:, None]] = np.concatenate([x for _, x, _ in rows])
                tokens = self.merge_rows(matrix)
                counts = (tokens >= 0).sum(axis=1)
                flat, at = tokens[tokens >= 0].tolist(), 0
                for (i, symbols, fed), n in zip(rows, counts.tolist(), strict=True):
                    own, at = flat[at : at + n], at + n
                    if fed == len(words[i]):
                        out[i] += own
                        continue
                    used = 0
                    for token in own:
                        if used + self.widths[token] + self.lookahead > len(symbols):
                            break
                        out[i].append(token)
                        used += int(self.widths[token])
                    held.append((i, symbols[used:], fed))
        return out

    @property
    def widths(self) -> np.ndarray:
        """Symbols in each token."""
        if not hasattr(self, "_widths"):
            widths = np.ones(self.size, np.int64)
            for u, v, w in self.triples:
                widths[w] = widths[u] + widths[v]
            self._widths = widths
        return self._widths

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of ``words`` into the cache."""
        if len(self.cache) + len(words) > KEPT:
            self.cache.clear()
        for w, ids in zip(words, self.stream([w.encode() for w in words]), strict=True):
            self.cache[w] = tuple(ids)

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens.

        Other characters than ``PLAIN`` ones are classed by the tokenizers
        library itself, whose version of Unicode is the one that counts.
        """
        if PLAIN.match(text):
            return PLAIN_WORDS.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, piece)).decode() for piece, _ in pieces]

    def split(self, text: str) -> list[str]:
        if self.marks is None or "<|" not in text:
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.marks.split(text)):
            out += [part] if i % 2 else self.words(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids start and end."""
        ids, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0

        def flushed():
            own, bounds = self.encode_together([part for _, part in group])
            ids.append(own)
            np.add.at(counts, [i for i, _ in group], np.diff(bounds))

        for i, text in enumerate(texts):
            for part in portions(text):
                group.append((i, part))
                size += len(part)
                if size >= PORTION:
                    flushed()
                    group, size = [], 0
        if group:
            flushed()
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(counts)])

    def encode_together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.split(t) for t in texts]
        known = self.cache
        distinct = set().union(*split)
        missing = [w for w in distinct if w not in known]
        if missing:
            if len(known) + len(missing) > KEPT:
                known.clear()
                missing = list(distinct)
            for text, token in self.special.items():
                known[text] = (token,)
            self.encode_words([w for w in missing if w not in self.special])
        order = {w: i for i, w in enumerate(distinct)}
        counts = np.fromiter((len(known[w]) for w in distinct), np.int64, len(distinct))
        flat = np.fromiter((t for w in distinct for t in known[w]), np.int32)
        begin = np.cumsum(counts) - counts
        per_text = np.array([len(s) for s in split], np.int64)
        codes = np.fromiter((order[w] for s in split for w in s), np.int64, int(per_text.sum()))
        n = counts[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[codes] - (ends - n), n) + np.arange(n.sum())]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, bounds


def portions(text: str):
    """Consecutive parts of a text, of ``PORTION`` characters or more, each but the first from a blank on: no word, special token or composed character crosses one."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + PORTION)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text."""

    def run(batches):
        model = merges(tokenizer)
        for batch in batches:
            for part in common.pieces(batch, "text"):
                ids, bounds = model.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return common.texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


class Decoder:
    """Byte-to-text state machine: takes ids in any portions, gives text as it becomes whole."""

    def __init__(self, model: Merges):
        self.table = decode_table(model)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: pa.Array, last: bool) -> str:
        data = joined(self.table.take(ids))
        if data and not self.begun:
            data, self.begun = data[1:], True
        return self.state.decode(data, last)


def joined(values: pa.Array) -> bytes:
    """The bytes of a binary array, one after the other."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return values.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if len(values) else b""


def decode_table(model: Merges) -> pa.Array:
    """Bytes of each id behind the blank that sets tokens apart."""
    if not hasattr(model, "_decode"):
        model._decode = pa.array([b" " + s.encode() for s in model.names], pa.large_binary())
    return model._decode


def decode(encoded: DataFrame, tokenizer: str, portion: int = 1 << 16) -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` text; special tokens are kept.

    Ids go through the state machine in portions of ``portion``.
    """

    def run(batches):
        model = merges(tokenizer)
        for batch in batches:
            for part in common.pieces_of_lists(batch, "ids"):
                lists, out = part.column("ids"), []
                for i in range(len(lists)):
                    ids, machine, text = lists[i].values, Decoder(model), []
                    n = 0 if ids is None else len(ids)
                    for at in range(0, n, portion):
                        text.append(machine.feed(ids.slice(at, portion), at + portion >= n))
                    out.append("".join(text))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: ``n_tokens`` and digests of its ids and of the text they decode to."""
    return decode(encode(docs, tokenizer), tokenizer).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
