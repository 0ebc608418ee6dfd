"""Shortest-pack-first packing of documents into fixed-length sequences.

One pass over the texts counts each document's tokens and cuts it into full
pieces and a rest.  Only the histogram of piece lengths (at most ``size`` rows)
reaches the driver, which places lengths longest first and keeps groups of
equal packing patterns with their counts.  Pieces then find their place by
their rank among pieces of equal length; ranks come from counts by task, so no
length is gathered in one task.

Rows: a null or empty text gives one piece, the closing id alone; repeated
rows are packed as often as they occur; ties in rank follow the order of
reading; extra columns of the input are not carried, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bpe import byte_symbols

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, chunk int, local long"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level vocabulary at ``path`` for fast counting; ids are those of the file."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = {c: b for b, c in byte_symbols().items()}
    ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return fast, Tokenizer.from_file(path)


def ids_of(text: str, tokenizer: str) -> np.ndarray:
    fast, exact = encoding(tokenizer)
    if text.isascii() or max(text) < "ɐ":
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
    return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")  # letters that Unicode versions may class apart


def cut(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """Pieces of at most ``size`` tokens, numbered by length within each task."""

    def run(batches):
        chunk, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            for part in common.pieces(batch, "text", 2 << 20):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(ids_of(text, tokenizer), np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), size):
                        own = ids[start : start + size]
                        rows.append((doc_id, start, len(own), zlib.crc32(own.tobytes()), len(ids), chunk, seen[len(own)]))
                        seen[len(own)] += 1
                kinds = (pa.int64(),) * 5 + (pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return common.texts(docs).mapInArrow(run, PIECES)


def place(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset) that place every piece.

    A pattern is a run of sequences filled alike: (first sequence, count,
    filled).  Lengths come longest first; each goes to the shortest packs, those
    with the most room, as long as it fits.  If none has room, as many
    sequences are opened as the rest of this length alone would fill.
    """
    room: dict[int, list[tuple[int, int, int]]] = {}
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank, space = histogram[length], 0, size
        while left:
            while space >= length and not room.get(space):
                space -= 1
            if space >= length:
                first, count, filled = room[space].pop()
            else:
                first, count, filled = sequences, -(-left // (size // length)), 0
                sequences += count
                space = size - length
            used = min(count, left)
            if used < count:
                room.setdefault(size - filled, []).append((first + used, count - used, filled))
            out.append((length, rank, used, first, filled))
            room.setdefault(size - filled - length, []).append((first, used, filled + length))
            left, rank = left - used, rank + used
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id start length ids_crc32 doc_tokens sequence_id offset``."""
    pieces = common.written(cut(docs, tokenizer, size, end_id), "pieces")
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("chunk", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = common.written(bases, "bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = np.array(place(histogram, size), np.int64).reshape(-1, 5)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    step = max(histogram.values(), default=0) + 1

    def run(batches):
        keys = places[:, 0] * step + places[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = places[np.searchsorted(keys, length * step + rank, side="right") - 1]
            out = {c: batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            out |= {"sequence_id": pa.array(own[:, 3] + rank - own[:, 1]), "offset": pa.array(own[:, 4])}
            yield pa.RecordBatch.from_pydict(out)

    ranked = pieces.join(bases, ["chunk", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
