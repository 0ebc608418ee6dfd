"""Alignment of two tokenizers' tokens by elementary intervals.

The ends of both token sequences, in bytes of space + text, are united; each
elementary interval between neighbouring ends has one owner on either side
(``searchsorted``) and is one overlap.  An end that both sides share closes a
group, and the links are the products of each group's A and B tokens.

Texts are taken apart at blanks where both sides end a token in any case, and
each distinct segment is encoded and aligned once in a task.  One pass writes, for each document, its distinct linked id pairs with their
number of links.  How many documents hold a pair is an ordinary groupBy over
those.  Looking the counts up again has two exact parts: the pairs that most
documents hold, at most ``HEAD`` of them, are broadcast; the rest are joined
by a shuffle, which no key can make uneven, since every frequent pair is in
the head.

Rows: a null or empty text, or one whose tokens do not spell space + text (a
normaliser changed it, or it holds U+2581), has no tokens: zeros and an empty
string.  Every row is a document of its own, whatever its id: repeated rows
and null ids count as often as they occur.  Equal counts are all "highest".
Extra columns are not carried, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import byte_symbols
from .packing import encoding

#: Pairs whose counts are broadcast, at most (17 bytes each).
HEAD = 1 << 20

#: Links that are expanded at a time.
PORTION = 1 << 20

#: Segments that a task remembers before it starts afresh.
SEGMENTS = 300_000

DOCUMENT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


@lru_cache(maxsize=2)
def vocabularies(a: str, b: str):
    """Encoders of both sides with the bytes of each of their tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte = {c: x for x, c in byte_symbols().items()}
    fast, _ = encoding(a)
    exact = Tokenizer.from_file(a)
    exact.encode_special_tokens = True
    exact.no_padding()
    exact.no_truncation()
    own = [bytes(byte[c] for c in exact.id_to_token(i)) if all(c in byte for c in exact.id_to_token(i)) else exact.id_to_token(i).encode() for i in range(exact.get_vocab_size())]
    pieces = sentencepiece.SentencePieceProcessor(model_file=b)
    other = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.get_piece_size())]
    return fast, exact, own, pieces, other


def tokens_a(texts: list[str], fast, exact) -> list[list[int]]:
    """Ids of each text; strings of special tokens are plain text."""
    plain = max(map(max, texts)) < "ɐ"  # other letters may be classed apart by another Unicode version
    return [fast.encode_ordinary(x) if plain or max(x) < "ɐ" else exact.encode(x, add_special_tokens=False).ids for x in texts]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each elementary interval: its A owner, its B owner and its group."""
    ends = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends)
    return owner_a, owner_b, np.cumsum(shared) - shared


def members(owner: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and number of tokens of each group, on one side; owners ascend with the intervals."""
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    size = np.bincount(group[new], minlength=n_groups)
    return np.cumsum(size) - size, size


def products(a: np.ndarray, b: np.ndarray, groups_a: tuple, groups_b: tuple, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs, as ``a * width + b``, of all groups' products, and the links of each.

    Every A token meets its group's B tokens; A tokens are taken in runs of
    about ``PORTION`` links, and pairs of a run are counted before the next.
    """
    (first_a, size_a), (first_b, size_b) = groups_a, groups_b
    partners, start = np.repeat(size_b, size_a), np.repeat(first_b, size_a)
    upto = np.cumsum(partners)
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PORTION, side="right")))
        n = partners[lo:hi]
        at = np.arange(n.sum()) + np.repeat(start[lo:hi] - (np.cumsum(n) - n), n)
        found, times = np.unique(np.repeat(a[lo:hi], n) * width + b[at], return_counts=True)
        if len(codes):
            found, place = np.unique(np.concatenate([codes, found]), return_inverse=True)
            times = np.bincount(place, np.concatenate([counts, times])).astype(np.int64)
        codes, counts, lo = found, times, hi
    return codes, counts


@lru_cache(maxsize=1)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1, left-aligned with room for a sign behind, and how many there are."""
    width = len(str(n))
    text = np.array([str(i).ljust(width + 1) for i in range(n)], f"S{width + 1}")
    return text.view(np.uint8).reshape(n, width + 1), np.array([len(str(i)) for i in range(n)])


def spelled(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, n_groups: np.ndarray, ids: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3``: each group's A ids and B ids, for consecutive texts of ``n_groups`` groups."""
    digits, length = decimals(ids)
    last = np.cumsum(size_a + size_b) - 1
    is_a = np.repeat(np.tile([True, False], len(size_a)), np.stack([size_a, size_b], 1).ravel())
    merged = np.empty(len(a) + len(b), np.int64)
    merged[is_a], merged[~is_a] = a, b
    signs = np.full(len(merged), ord(","), np.uint8)
    signs[last - size_b], signs[last] = ord("|"), ord(";")
    rows, n = digits[merged], length[merged]
    rows[np.arange(len(rows)), n] = signs
    flat = rows[np.arange(rows.shape[1]) <= n[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(n + 1)[last]])[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
    return [flat[i : max(i, j - 1)] for i, j in zip(ends, ends[1:])]


class Segments:
    """What a text's segments give, each worked out once.

    A segment starts at a single blank between two characters that are no
    white space.  Neither tokenizer joins across such a blank (A's pattern
    starts anew there, none of B's pieces holds a blank behind another
    character), so that both sides end a token there, groups lie within
    segments, and a document is the sum of its segments.
    """

    BORDER = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, a: str, b: str):
        self.fast, self.exact, self.own, self.pieces, self.other = vocabularies(a, b)
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.own, self.other))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.fresh: list[str] = []
        self.text: list[bytes] = []
        self.valid, self.sizes = np.empty(0, bool), np.empty((0, 4), np.int64)
        self.pairs, self.links, self.first = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)

    def numbered(self, text: str) -> list[int]:
        """The segments of space + ``text`` by number; new ones wait for ``settle``."""
        out, index = self.BORDER.split(f" {text}"), self.index
        for x in out:
            if x not in index:
                index[x] = len(index)
                self.fresh.append(x)
        return [index[x] for x in out]

    def settle(self) -> None:
        """Encode and align the new segments, laid end to end."""
        if not self.fresh:
            return
        all_a = tokens_a(self.fresh, self.fast, self.exact)
        all_b = self.pieces.encode([x[1:] for x in self.fresh], num_threads=1)
        valid = []
        for k, (x, of_a, of_b) in enumerate(zip(self.fresh, all_a, all_b, strict=True)):
            data = x.encode()
            valid.append(b"".join([self.other[i] for i in of_b]) == data == b"".join([self.own[i] for i in of_a]))
            if not valid[-1]:
                all_a[k] = all_b[k] = []
        n_a, n_b = (np.array([len(x) for x in side]) for side in (all_a, all_b))
        a, b = (np.array([i for x in side for i in x], np.int64) for side in (all_a, all_b))
        if len(a):
            owner_a, owner_b, group = overlaps(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
            n = int(group[-1]) + 1
            groups_a, groups_b = members(owner_a, group, n), members(owner_b, group, n)
        else:
            n, groups_a, groups_b = 0, (a, a), (a, a)
        of_token = np.repeat(np.arange(len(self.fresh)), n_a)
        n_groups = np.bincount(of_token[groups_a[0]], minlength=len(self.fresh))
        space = len(self.own) * len(self.other)
        codes, links = products(of_token * len(self.own) + a, b, groups_a, groups_b, len(self.other))
        of_pair = codes // space
        size = np.bincount(of_pair, minlength=len(self.fresh))
        self.text += spelled(a, b, groups_a[1], groups_b[1], n_groups, max(len(self.own), len(self.other)))
        self.valid = np.concatenate([self.valid, valid])
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, np.bincount(of_pair, links, len(self.fresh)).astype(np.int64)], 1)])
        self.pairs, self.links = np.concatenate([self.pairs, codes % space]), np.concatenate([self.links, links])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.fresh = []


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per document: ``row doc_id n_a n_b n_groups n_links groups_sha256 pairs links``."""

    def run(batches):
        segments = Segments(a, b)
        space = len(segments.own) * len(segments.other)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in common.pieces(batch, "text", 2 << 20):
                if len(segments.index) > SEGMENTS:
                    segments.clear()
                lists = [segments.numbered(t) if t else [] for t in part.column("text").to_pylist()]
                segments.settle()
                length = np.array([len(x) for x in lists])
                doc, flat = np.repeat(np.arange(len(lists)), length), np.array([i for x in lists for i in x], np.int64)
                valid = (total(~segments.valid[flat], length) == 0) & (length > 0)
                doc, flat = doc[valid[doc]], flat[valid[doc]]
                sizes = total(segments.sizes[flat], length * valid)
                text = segments.text
                digests = [hashlib.sha256(b";".join([text[i] for i in x])).hexdigest() if ok else "" for x, ok in zip(lists, valid, strict=True)]
                held, times = np.unique(doc * len(text) + flat, return_counts=True)
                doc, flat = held // len(text), held % len(text)
                n = segments.first[flat + 1] - segments.first[flat]
                at = np.arange(n.sum()) + np.repeat(segments.first[flat] - (np.cumsum(n) - n), n)
                pairs, place = np.unique(np.repeat(doc, n) * space + segments.pairs[at], return_inverse=True)
                links = np.bincount(place, np.repeat(times, n) * segments.links[at]).astype(np.int64)
                offsets = pa.array(np.searchsorted(pairs, np.arange(len(lists) + 1) * space).astype(np.int32))
                columns = [pa.array(np.arange(row, row + len(lists))), part.column("doc_id"), *(pa.array(x) for x in sizes.T), pa.array(digests, pa.string())]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pairs % space, links)]
                yield pa.RecordBatch.from_arrays(columns, [*KEPT, "pairs", "links"])
                row += len(lists)

    return common.texts(docs).mapInArrow(run, f"{DOCUMENT}, pairs array<long>, links array<long>")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """``pair a n best``: the documents that hold each pair, and whether no pair of its A id has more."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = common.written(counts.withColumn("a", F.expr(f"pair div {width}")), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return common.written(counts.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per document: ``doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256``."""
    import sentencepiece

    spark, width = docs.sparkSession, sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    found = common.written(aligned(docs, a, b), "aligned")
    counts = pair_counts(found, width)
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("n")).collect())
    least = 0  # pairs in 2 ** least documents or more are the head
    while sum(n for power, n in sizes.items() if power >= least) > HEAD:
        least += 1
    head = counts.filter(F.col("n") >= 2**least).orderBy("pair").select("pair", "n", "best").toArrow()
    sent = spark.sparkContext.broadcast(tuple(head.column(c).to_numpy() for c in ("pair", "n", "best")))
    rest = least > min(sizes, default=least)

    def run(batches):
        codes, n, best = sent.value
        for batch in batches:
            for part in common.pieces_of_lists(batch, "pairs"):
                pairs, links = (part.column(c).flatten().to_numpy() for c in ("pairs", "links"))
                length = np.diff(part.column("pairs").offsets.to_numpy())
                at = np.minimum(np.searchsorted(codes, pairs), max(0, len(codes) - 1))
                known = codes[at] == pairs if len(codes) else np.zeros(len(pairs), bool)
                weight = np.where(known, links, 0)
                sums = [total(weight * x[at], length) if len(codes) else np.zeros(len(length), np.int64) for x in (best, n)]
                out = {c: part.column(c) for c in KEPT}
                out |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
                if rest:
                    offsets = np.concatenate([[0], np.cumsum(total(~known, length))]).astype(np.int32)
                    out |= {c: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[~known])) for c, x in (("pairs", pairs), ("links", links))}
                yield pa.RecordBatch.from_pydict(out)

    looked_up = found.mapInArrow(run, f"{DOCUMENT}, n_best long, count_sum long" + ", pairs array<long>, links array<long>" * rest)
    if rest:
        looked_up = common.written(looked_up, "looked")
        more = looked_up.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", "x.*").withColumnRenamed("pairs", "pair")
        more = more.join(counts.filter(F.col("n") < 2**least), "pair").groupBy("row")
        more = more.agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best_more"), F.sum(F.col("links") * F.col("n")).alias("sum_more"))
        looked_up = looked_up.join(more, "row", "left")
        for c, x in (("n_best", "best_more"), ("count_sum", "sum_more")):
            looked_up = looked_up.withColumn(c, F.col(c) + F.coalesce(x, F.lit(0)))
    return looked_up.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


KEPT = [x.split()[0] for x in DOCUMENT.split(", ")]


def total(values: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, in 64-bit integers."""
    upto = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    ends = np.cumsum(length)
    return upto[ends] - upto[ends - length]
