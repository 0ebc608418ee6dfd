"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected ``ORDERINGS`` times to ``DIMENSIONS`` random directions,
shifted, and ordered along a Hilbert curve; Spark range-partitions and ranks
each ordering.  A query's candidates are the vectors at most ``window`` ranks
away in some ordering; they are reranked by true distance and merged.

The window follows from the data: for a sample of ``SAMPLE`` queries the true
neighbours are found by a scan in blocks, and the window is the distance in
ranks that reaches the share ``TARGET`` of them, but no less than ``k + 1``, so
that every query finds ``k`` neighbours, or all where there are fewer.  On clustered data it stays
small; on data without structure it grows with the table, as it must for the
recall asked for.

Equal vectors are indexed once, with their ``k + 1`` smallest ids: no other
copy can be among ``k`` neighbours.

Rows: vectors that are null, zero, of another than the prevailing length, or
hold null or non-finite components take no part; ties go to the smaller id;
rows that repeat an id and vector count once; extra columns of the input are
not carried, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDERINGS, DIMENSIONS, BITS = 16, 8, 7
SAMPLE, TARGET = 64, 0.95


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of grid coordinates (columns times ``bits`` is at most 63)."""
    x = cells.T.astype(np.int64).copy()
    n, bit = len(x), 1 << (bits - 1)
    while bit > 1:  # undo the turns and reflections, from the coarsest cells on
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> b) & 1)
    return out


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid(vectors: DataFrame) -> DataFrame:
    """Rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    own = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))
    size = own.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.filter(F.size("embedding") == (size["n"] if size else 0))


def distinct(own: DataFrame, k: int) -> DataFrame:
    """``vid embedding ids``: each different vector with its ``k + 1`` smallest ids, the first of which names it."""
    rank = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = own.withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return few.select(F.col("ids")[0].alias("vid"), "embedding", "ids")


def ranked(unique: DataFrame) -> DataFrame:
    """``ordering rank vid embedding`` along every curve."""
    spark = unique.sparkSession
    size = len((unique.select("embedding").first() or [[0]])[0])
    dims = min(DIMENSIONS, size)
    rng = np.random.default_rng(11)
    bases = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, :dims] for _ in range(ORDERINGS)]
    shifts = rng.random((ORDERINGS, dims))
    joined = np.concatenate(bases, axis=1)

    def project(column):
        return matrix(column) @ joined

    def ranges(batches):
        for batch in batches:
            z = project(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(z.shape[1])), pa.array(z.min(axis=0)), pa.array(z.max(axis=0))], ["i", "low", "high"])

    edges = unique.select("embedding").mapInArrow(ranges, "i long, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    low, high = (np.array([r[c] for r in edges]) for c in ("low", "high"))

    def keys(batches):
        for batch in batches:
            z = (project(batch.column("embedding")) - low) / np.maximum(high - low, 1e-300)
            for o in range(ORDERINGS):
                cells = ((z[:, o * dims : (o + 1) * dims] + shifts[o]) / 2 * (1 << BITS)).clip(0, (1 << BITS) - 1)
                key = hilbert(cells.astype(np.int64), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), o, np.int32)), pa.array(key), batch.column("vid"), batch.column("embedding")], ["ordering", "key", "vid", "embedding"])

    def numbered(batches):
        chunk, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            orderings = batch.column("ordering").to_numpy()
            local = np.zeros(len(orderings), np.int64)
            for o in np.unique(orderings).tolist():
                own = orderings == o
                local[own] = seen.get(o, 0) + np.arange(own.sum())
                seen[o] = seen.get(o, 0) + int(own.sum())
            yield pa.RecordBatch.from_arrays([batch.column("ordering"), pa.array(np.full(len(local), chunk, np.int32)), pa.array(local), batch.column("vid"), batch.column("embedding")], ["ordering", "chunk", "local", "vid", "embedding"])

    element = unique.schema["embedding"].dataType.simpleString()
    parts = max(2 * ORDERINGS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = unique.mapInArrow(keys, f"ordering int, key long, vid long, embedding {element}").repartitionByRange(parts, "ordering", "key", "vid").sortWithinPartitions("ordering", "key", "vid")
    table = common.written(dealt.mapInArrow(numbered, f"ordering int, chunk int, local long, vid long, embedding {element}"), "orderings")
    before = Window.partitionBy("ordering").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases_ = table.groupBy("ordering", "chunk").agg(F.count("*").alias("n")).select("ordering", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return common.written(table.join(bases_, ["ordering", "chunk"]).select("ordering", (F.col("base") + F.col("local")).alias("rank"), "vid", "embedding"), "ranks")


def nearest(queries: np.ndarray, names: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` nearest (name, id, distance) of each query; ties to the smaller id."""
    out = ([], [], [])
    middle = vectors.mean(axis=0)
    centred = vectors - middle  # far from the origin, products would lose the distances' digits
    square = (centred * centred).sum(axis=1)
    for at in range(0, len(queries), 256):
        own = queries[at : at + 256]
        moved = own - middle
        rough = square - 2 * (moved @ centred.T)
        last = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        slack = 1e-9 * (square.max() + (moved * moved).sum(axis=1))  # ties and rounding: whatever may be as near as the last
        few = (np.flatnonzero(r <= t) for r, t in zip(rough, last + slack, strict=True))
        for q, name, pick in zip(own, names[at : at + 256].tolist(), few, strict=True):
            d = np.sqrt(((vectors[pick] - q) ** 2).sum(axis=1))
            best = np.lexsort((ids[pick], d))[:k]
            out[0].extend([name] * len(best))
            out[1].extend(ids[pick][best].tolist())
            out[2].extend(d[best].tolist())
    return out


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each ``q``."""
    order = F.row_number().over(Window.partitionBy("q").orderBy("score", "vid"))
    return rows.distinct().withColumn("n", order).filter(F.col("n") <= k).drop("n")


FOUND = "q long, vid long, score double"


def _found(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "vid", "score"])


def scan(unique: DataFrame, queries: list, k: int) -> DataFrame:
    """True neighbours ``q vid score`` of a bounded list of query rows (vid, embedding), block by block."""
    names, own = np.array([r["vid"] for r in queries]), np.array([r["embedding"] for r in queries], np.float64)

    def run(batches):
        for batch in batches:
            yield _found(nearest(own, names, matrix(batch.column("embedding")), batch.column("vid").to_numpy(), k))

    return _best(unique.select("vid", "embedding").mapInArrow(run, FOUND), k)


def window(unique: DataFrame, ranks: DataFrame, queries: DataFrame, k: int) -> int:
    """Ranks around a query within which ``TARGET`` of its true neighbours lie in some ordering."""
    sample = queries.join(unique, "vid").orderBy(F.xxhash64("vid"), "vid").select("vid", "embedding").limit(SAMPLE).collect()
    if not sample:
        return k + 1
    truth = F.broadcast(scan(unique, sample, k + 1).filter("q <> vid"))
    place = ranks.select("ordering", "rank", "vid")
    near = place.join(truth, "vid").select("ordering", "q", "vid", "rank")
    home = place.join(F.broadcast(truth.select("q").distinct()), F.col("vid") == F.col("q")).select("ordering", "q", F.col("rank").alias("home"))
    gaps = near.join(home, ["ordering", "q"]).groupBy("q", "vid").agg(F.min(F.abs(F.col("rank") - F.col("home"))).alias("gap"))
    return max(int(gaps.agg(F.percentile("gap", TARGET)).first()[0] or 0), k) + 1


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """``query_id rank vec_id score`` for the rows whose id is divisible by ``every``."""
    own = valid(vectors)
    unique = common.written(distinct(own, k), "vectors")
    asked = own.filter(F.col("vec_id") % every == 0).distinct().join(unique.select("vid", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "vid")
    asked = common.written(asked, "queries")
    names = common.written(asked.select("vid").distinct(), "names")
    ranks = ranked(unique)
    reach = window(unique, ranks, names, k)
    block = F.floor(F.col("rank") / reach).cast("long")
    blocks = ranks.select("ordering", block.alias("block"), "rank", "vid", "embedding")
    homes = blocks.join(names, "vid").select("ordering", F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"), "rank", "vid", "embedding")
    homes = common.written(homes, "homes")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([_found(([], [], []))])
        queries, vectors_ = (matrix(t.column("embedding").combine_chunks()) for t in (left, right))
        rows, ids, places = nearest_within(queries, left, vectors_, right)
        return pa.Table.from_batches([_found((rows, ids, places))])

    def nearest_within(queries, left, vectors_, right):
        """As ``nearest``, for vectors at most ``reach`` ranks away; runs of vectors are slices, as both sides are sorted by rank."""
        order = np.argsort(right.column("rank").to_numpy())
        ranks_, ids, vectors_ = right.column("rank").to_numpy()[order], right.column("vid").to_numpy()[order], vectors_[order]
        out = ([], [], [])
        lows = np.searchsorted(ranks_, left.column("rank").to_numpy() - reach)
        highs = np.searchsorted(ranks_, left.column("rank").to_numpy() + reach, side="right")
        for i, (a, b) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True)):
            if a < b:
                got = nearest(queries[i : i + 1], left.column("vid").to_numpy()[i : i + 1], vectors_[a:b], ids[a:b], k + 1)
                for to, more in zip(out, got, strict=True):
                    to.extend(more)
        return out

    found = homes.groupBy("ordering", "block").cogroup(blocks.groupBy("ordering", "block")).applyInArrow(near, FOUND)
    best = common.written(_best(found, k + 1), "nearest")
    each = asked.join(best, asked["vid"] == best["q"]).select("query_id", best["vid"], "score").join(unique.select("vid", F.explode("ids").alias("vec_id")), "vid")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    each = each.filter("vec_id <> query_id").withColumn("rank", order).filter(F.col("rank") <= k)
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
