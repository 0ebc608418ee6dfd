"""Ranked lexical search: WAND over document shards, shard heaps merged.

Queries come in blocks of bounded size.  For a block, one pass over the texts
keeps each document's length and its occurrences of the block's terms, as
postings in the shared folder; document frequencies, the number of documents
and their length are ordinary aggregates over those.  A second pass takes the
postings in shards.  A shard turns them into one list per term, ordered by
document, with impacts and the largest impact of the list.  For a query, lists
are ordered by their largest impacts: a document can only be a pivot from the
first list at which the maxima still ahead reach the threshold of the query's
heap, so that the lists behind are not walked but looked into at the
documents that can still beat it, and documents that cannot are skipped.
A task keeps its heaps from shard to shard and returns at most ``k`` rows a
query; these are merged in two steps, first within slices of the tasks.

Rows: a document without text or terms takes no part and does not count in N;
each row is a document of its own, so repeated rows take a rank each; equal
scores go by ascending id, null ids last.  Rows of one item id are one item
with the terms of all their texts; an item without terms finds nothing.
Extra columns are not carried, whatever their names; empty tables give an
empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of query text in a block (about; one longer query is a block by itself).
BLOCK = 4 << 20

#: Documents and postings of a shard, at most (one document more may pass the second).
SHARD, POSTINGS = 1 << 15, 1 << 22

#: Documents that a query with a heap not yet full looks at before it sets a threshold.
OPENING = 256

#: Slices in which the tasks' heaps are merged first.
SLICES = 64

#: A-Z in lower case; 0-9, a-z and all bytes of other characters as they are; the rest separates terms.
SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(SIGNS).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id n terms tfs`` of each document with a term: its length and its occurrences of the vocabulary."""
    sent, size = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary) + 1

    def run(batches):
        known = sent.value
        for batch in batches:
            for part in common.pieces(batch, "text"):
                length, found = [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    words = terms(text)
                    length.append(len(words))
                    found.append([known[w] for w in words if w in known])
                doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
                keys, tf = np.unique(doc * size + np.array([t for x in found for t in x], np.int64), return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(found) + 1) * size).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % size, tf)]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(length, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array([n > 0 for n in length]))

    return common.texts(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Posting lists of some documents: for each term, documents in their order with impacts."""

    def __init__(self, part: pa.Table, weights: np.ndarray, n_documents: int, n_terms: int):
        missing = part.column("doc_id").is_null().to_numpy()
        ids = part.column("doc_id").fill_null(0).to_numpy()
        order = np.lexsort((ids, missing))  # so that the earlier of equal documents comes first
        self.ids, self.missing = ids[order], missing[order]
        lists = part.column("terms").combine_chunks()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), part.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        by_term = np.lexsort((doc, term))
        doc, term, tf = doc[by_term], term[by_term], tf[by_term]
        m = 50 + (50 * part.column("n").to_numpy()[order] * n_documents) // n_terms
        self.docs, self.impacts = doc, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        present, first = np.unique(term, return_index=True)
        most = np.maximum.reduceat(self.impacts, first) if len(first) else first
        self.lists = {t: (i, j, u) for t, i, j, u in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(term)], most.tolist(), strict=True)}

    def scored(self, query: list[int], lo: int, hi: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents in ``[lo, hi)`` with a score of at least ``least``, and their scores."""
        own = sorted((self.lists[t] for t in query if t in self.lists), key=lambda x: -x[2])
        ahead = np.cumsum([x[2] for x in own][::-1])[::-1].tolist() + [0]  # maxima of a list and those behind it
        score, found = np.zeros(hi - lo, np.int64), None
        for k, (i, j, _) in enumerate(own):
            i, j = (i + np.searchsorted(self.docs[i:j], x) for x in (lo, hi))
            if ahead[k] >= least:  # a pivot may start here
                score[self.docs[i:j] - lo] += self.impacts[i:j]
                continue
            if found is None:
                found = np.flatnonzero(score)
            found = found[score[found] + ahead[k] >= least]
            if not len(found):
                break
            at = i + np.searchsorted(self.docs[i:j], found + lo)
            held = at < j
            held[held] = self.docs[at[held]] == found[held] + lo
            score[found[held]] += self.impacts[at[held]]
        found = np.flatnonzero(score) if found is None else found
        found = found[score[found] >= least]
        return found + lo, score[found]


class Heap:
    """The best ``k`` documents of a query so far: highest score, then smallest id, then null ids."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.missing = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int:
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        score, ids, missing = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.missing, missing)))
        best = np.lexsort((ids, missing, -score))[: self.k]
        self.score, self.ids, self.missing = score[best], ids[best], missing[best]


def shards(batches):
    """Tables of at most ``SHARD`` documents and about ``POSTINGS`` postings."""
    kept, rows, held = [], 0, 0
    for batch in batches:
        for part in common.pieces_of_lists(batch, "terms"):
            for i in range(0, part.num_rows, SHARD):
                own = part.slice(i, SHARD)
                n = len(own.column("terms").flatten())
                if kept and (rows + own.num_rows > SHARD or held + n > POSTINGS):
                    yield pa.Table.from_batches(kept)
                    kept, rows, held = [], 0, 0
                kept, rows, held = [*kept, own], rows + own.num_rows, held + n
    if kept:
        yield pa.Table.from_batches(kept)


def best_of_tasks(found: DataFrame, queries: list[list[int]], weights: np.ndarray, n_documents: int, n_terms: int, k: int) -> DataFrame:
    """``item slice doc_id score``: the best ``k`` of each task's documents for every query."""
    sent = found.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = sent.value
        heaps = [Heap(k) for _ in queries]
        for part in shards(batches):
            shard = Shard(part, weights, n_documents, n_terms)
            for query, heap in zip(queries, heaps, strict=True):
                lo = 0
                while lo < len(shard.ids):
                    hi = min(len(shard.ids), lo + OPENING) if len(heap.score) < k else len(shard.ids)
                    docs, score = shard.scored(query, lo, hi, heap.least())
                    heap.add(score, shard.ids[docs], shard.missing[docs])
                    lo = hi
        for i in range(0, len(heaps), 1000):
            own = heaps[i : i + 1000]
            item = np.repeat(np.arange(i, i + len(own)), [len(h.score) for h in own]).astype(np.int32)
            ids = pa.array(np.concatenate([h.ids for h in own]), mask=np.concatenate([h.missing for h in own]))
            yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(np.concatenate([h.score for h in own]))], ["item", "doc_id", "score"])

    best = found.mapInArrow(run, "item int, doc_id long, score long")
    return best.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Each item's ``k`` best documents: ``item_id rank doc_id score``."""
    spark = docs.sparkSession
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = math.ceil((items.agg(F.sum(F.octet_length("text"))).head()[0] or 0) / BLOCK)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own: dict = {}
        for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            own.setdefault(r["item_id"], set()).update(terms(r["text"].encode()))
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*own.values())))}
        found = common.written(postings(docs, vocabulary), "postings")
        n_documents, n_terms = found.agg(F.count("*"), F.sum("n")).head()
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        if not n_terms:
            continue
        best = best_of_tasks(found, [[vocabulary[t] for t in own[i]] for i in own], weights, n_documents, n_terms, k)
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        for keys in (("item", "slice"), ("item",)):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(own)), "item int, item_id long")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
