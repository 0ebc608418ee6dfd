"""Edit operations between what was read and what is true, row by row, and the confusions that they add up to."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Length of one string times that of the other up to which differences are kept as bits.
BITS = 1 << 28


def edits(read: str, true: str) -> tuple[int, int, int, Counter]:
    """Substitutions, insertions, deletions and the substituted pairs (true, read) of a shortest edit script.

    Goes back from the end; a step along both strings comes before one along
    what was read, and that before one along the truth.  The differences of
    neighbouring prefixes' distances are kept as bits of whole numbers, one a
    row; of long strings only a band around the diagonal is filled instead.
    """
    n, m, subs, ins, dels, pairs = len(read), len(true), 0, 0, 0, Counter()
    both, along = differences(read, true) if n * m <= BITS else filled(read, true)
    i, j = n, m
    while i or j:
        if i and j and (read[i - 1] == true[j - 1] or both(i, j)):
            if read[i - 1] != true[j - 1]:
                subs += 1
                pairs[true[j - 1], read[i - 1]] += 1
            i, j = i - 1, j - 1
        elif i and (not j or along(i, j)):
            ins, i = ins + 1, i - 1
        else:
            dels, j = dels + 1, j - 1
    return subs, ins, dels, pairs


def differences(read: str, true: str):
    """Whether the distance at (i, j) is one more than at (i - 1, j - 1), and than at (i - 1, j), for i and j from 1."""
    masks: dict[str, int] = {}
    for j, c in enumerate(true):
        masks[c] = masks.get(c, 0) | 1 << j
    every = (1 << len(true)) - 1
    up, down, level, more = every, 0, [], []
    for c in read:
        x = masks.get(c, 0) | down
        alike = ((up + (x & up)) ^ up | x) & every
        rises, falls = down | every & ~(up | alike), up & alike
        level.append(alike)
        more.append(rises)
        x = rises << 1 | 1
        up, down = (falls << 1 | ~(x | alike)) & every, x & alike
    return lambda i, j: not level[i - 1] >> (j - 1) & 1, lambda i, j: more[i - 1] >> (j - 1) & 1


def filled(read: str, true: str):
    """The same as ``differences``, from a table of the band around the diagonal.

    An edit script of k steps does not leave the band of width k, so that the
    band is doubled until the distance fits in.
    """
    n, m = len(read), len(true)
    a, b = (np.array([ord(c) for c in s], np.int32) for s in (read, true))
    k = max(8, abs(n - m))
    while True:
        table = banded(a, b, k)
        if int(table[n, m - n + k]) <= k:
            break
        k *= 2
    at = lambda i, j: int(table[i, j - i + k]) if abs(j - i) <= k else 1 << 30
    return lambda i, j: at(i, j) == at(i - 1, j - 1) + 1, lambda i, j: at(i, j) == at(i - 1, j) + 1


def banded(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Distances of all prefixes of ``a`` (rows) and ``b``, column j at j - i + k; large outside the band."""
    n, m, far = len(a), len(b), 1 << 29
    table = np.full((n + 1, 2 * k + 1), far, np.int32)
    offset = np.arange(2 * k + 1)
    j = offset - k
    table[0] = np.where((j >= 0) & (j <= m), j, far)
    padded = np.concatenate([np.full(k + 1, -1, np.int32), b, np.full(n + k + 1, -1, np.int32)])
    for i in range(1, n + 1):
        j = offset + i - k
        inside = (j >= 0) & (j <= m)
        other = padded[i : i + 2 * k + 1]  # b[j - 1] for the band of row i
        step = table[i - 1] + (other != a[i - 1])
        step[j == 0] = i
        down = np.append(table[i - 1][1:], far) + 1
        row = np.where(inside, np.minimum(step, down), far)
        # a run to the right: the least of row[x] + (distance from x)
        table[i] = np.where(inside, np.minimum.accumulate(row - offset) + offset, far)
    return table


def aligned(pairs: DataFrame, *keys: str) -> DataFrame:
    """``keys errors subs ins dels length confusions`` of each row of ``pairs`` (keys read true); nulls count as empty.

    Rows are dealt anew, as a small file of long texts would be one task.
    """

    def run(batches):
        for batch in batches:
            read, true = (batch.column(c).to_pylist() for c in ("read", "true"))
            done = [edits(r, t) for r, t in zip(read, true, strict=True)]
            lists = pa.array([[{"true": t, "read": r, "n": n} for (t, r), n in sorted(d[3].items())] for d in done], pa.list_(pa.struct([("true", pa.string()), ("read", pa.string()), ("n", pa.int64())])))
            counts = [pa.array([d[i] for d in done], pa.int64()) for i in range(3)]
            errors, length = pa.array([sum(d[:3]) for d in done], pa.int64()), pa.array([len(t) for t in true], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), errors, *counts, length, lists], [*keys, "errors", "subs", "ins", "dels", "length", "confusions"])

    own = pairs.select(*keys, *(F.coalesce(c, F.lit("")).alias(c) for c in ("read", "true")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keys).schema)
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(n, *keys, "read", "true").mapInArrow(run, f"{kinds}, errors long, subs long, ins long, dels long, length long, confusions array<struct<true: string, read: string, n: long>>")


def confusions(aligned_rows: DataFrame) -> DataFrame:
    """``true read n``: how often each sign was read as another, over all rows."""
    return aligned_rows.select(F.inline("confusions")).groupBy("true", "read").agg(F.sum("n").alias("n"))


def verdicts(rows: DataFrame) -> DataFrame:
    """``rows`` (a b true: two readings and the truth) with ``bucket``: which of both is wrong, and if both are, whether alike."""
    a, b = F.col("a") == F.col("true"), F.col("b") == F.col("true")
    both = F.when(F.col("a") == F.col("b"), "both_wrong_same").otherwise("both_wrong_different")
    return rows.withColumn("bucket", F.when(a & b, "both_right").when(b, "a_wrong").when(a, "b_wrong").otherwise(both))
