"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from pageloom.llm import wand

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string, item string", "item_id long, text string, rank string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    own = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    n, total = len(own), sum(x[2] for x in own)
    wanted, out = {}, []
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    df = Counter(w for _, c, _ in own for w in c)
    for i, terms in wanted.items():
        scored = []
        for d, tf, length in own:
            m = 50 + 50 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * m)) for w in terms if tf[w])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def made():
    rng = random.Random(5)
    vocabulary = [f"w{int(1 / (rng.random() + 0.002))}" for _ in range(4000)]
    docs = [(i * 3, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(700)]
    docs += [(7, "Zebra zebra, zebra"), (7, "Zebra zebra, zebra"), (None, "zebra w1"), (None, "zebra w1"), (5, None), (8, ""), (10, "  .,- "), (11, "é É ßtraße 日本 ½"), (13, "w1 " * 5000), (2, "ZEBRA")]
    docs += [(10_000 + i, "same words in every copy") for i in range(90)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "unheard"), (103, "zebra W1 zebra"), (104, "É 日本 ßtraße"), (105, "same words"), (106, "one"), (106, "w2"), (106, "w2"), (None, "w3 zebra")]
    return docs, items


@pytest.mark.parametrize(("shard", "opening", "block", "slices"), [(wand.SHARD, wand.OPENING, wand.BLOCK, wand.SLICES), (40, 3, 300, 2)])
def test_against_all_scores(spark, monkeypatch, shard, opening, block, slices):
    for name, value in (("SHARD", shard), ("OPENING", opening), ("BLOCK", block), ("SLICES", slices)):
        monkeypatch.setattr(wand, name, value)
    docs, items = made()
    found = wand.search(spark.createDataFrame([(*r, "a", "b") for r in docs], DOCS).repartition(5), spark.createDataFrame([(*r, "c") for r in items], ITEMS), 20)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 20)


def test_skips_documents():
    """A full heap leaves documents out that hold only common words."""
    import numpy as np
    import pyarrow as pa

    n = 1000
    lists = [[0] if i % 100 else [0, 1] for i in range(n)]
    part = pa.table({"doc_id": range(n), "n": [10] * n, "terms": pa.array(lists, pa.list_(pa.int32())), "tfs": pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))})
    shard = wand.Shard(part, np.array([5, 4000]), n, 10 * n)
    everything = shard.scored([0, 1], 0, n, 1)
    assert len(everything[0]) == n
    docs, score = shard.scored([0, 1], 0, n, int(max(everything[1])))
    assert docs.tolist() == list(range(0, n, 100)) and set(score) == {max(everything[1])}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", None, None)], DOCS)
    wanted = spark.createDataFrame([(1, "a", None)], ITEMS)
    assert wand.search(docs, items).count() == wand.search(some, items).count() == wand.search(docs, wanted).count() == 0
    assert [tuple(r) for r in wand.search(some, wanted).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (1_000_000_000 // (1000 + 20 * 100)))]
