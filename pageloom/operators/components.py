"""Connected components of ink, over runs of pixels instead of single ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt_once, dropped, kept

#: Runs that a task links and labels; the number of tasks is given to Spark, which would merge them by their packed size.
RUNS = 100_000
#: Links that a task takes together, in whole pages; a page of more is taken in parts.
LINKS = 1 << 20


def ink_runs(rows: DataFrame) -> DataFrame:
    """``page_id run y l r``: maximal runs of ink in each row (``r`` exclusive), numbered in raster order by ``run``."""
    ink = rows.select("page_id", "y", F.posexplode("ink").alias("x", "v")).filter("v = 1")
    island = F.col("x") - F.row_number().over(Window.partitionBy("page_id", "y").orderBy("x"))
    out = ink.withColumn("island", island).groupBy("page_id", "y", "island").agg(F.min("x").alias("l"), (F.max("x") + 1).alias("r"))
    return out.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("y", "l")).alias("run"), "y", "l", "r")


def touching(runs: DataFrame, reach: int) -> DataFrame:
    """``page_id run other``: runs of neighbouring rows that overlap (reach 0), or meet at a corner at least (1).

    Two rows' runs are swept together in the order of their ends, so that none
    are paired that do not touch: as runs of one row are disjoint, those that
    a run touches in the row below are consecutive there.  The row below is
    numbered; how many of its runs end before a run begins, and begin before
    it ends, are running counts over both rows' ends.
    """
    place = Window.partitionBy("page_id", "y").orderBy("l")
    own = runs.withColumn("k", F.row_number().over(place))
    event = lambda y, at, low, kind: F.struct(y.alias("y"), at.alias("at"), F.lit(low).alias("low"), F.lit(kind).alias("kind"))
    y, l, r = F.col("y"), F.col("l").cast("long"), F.col("r").cast("long")
    # a run below ends before x where r <= x - reach, and begins before x where l < x + reach
    events = own.select("page_id", "run", F.inline(F.array(
        event(y - 1, r + reach, 0, "ended"), event(y, l, 1, "from"), event(y, r, 2, "to"), event(y - 1, l - reach, 3, "begun"),
    )))
    upto = Window.partitionBy("page_id", "y").orderBy("at", "low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended, begun = (F.sum((F.col("kind") == k).cast("int")).over(upto).alias(k) for k in ("ended", "begun"))
    counted = events.select("page_id", "y", "run", "kind", ended, begun).filter("kind in ('from', 'to')")
    ends = counted.groupBy("page_id", "y", "run").agg(F.max(F.when(F.col("kind") == "from", F.col("ended"))).alias("lo"), F.max(F.when(F.col("kind") == "to", F.col("begun"))).alias("hi")).filter("hi > lo")
    wanted = ends.select("page_id", (F.col("y") + 1).alias("y"), "run", F.explode(F.sequence((F.col("lo") + 1).cast("int"), F.col("hi").cast("int"))).alias("k"))
    return wanted.join(own.select("page_id", "y", "k", F.col("run").alias("other")), ["page_id", "y", "k"]).select("page_id", "run", "other")


def least_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by the links a-b."""
    own = np.arange(n)
    while True:
        x, y = own[a], own[b]
        less, next_ = np.minimum(x, y), own.copy()
        np.minimum.at(next_, x, less)
        np.minimum.at(next_, y, less)
        while (next_[next_] != next_).any():
            next_ = next_[next_]
        if (next_ == own).all():
            return own
        own = next_


def contracted(links: DataFrame, n: int) -> DataFrame:
    """``page_id run other parted``: each linked run with the first run of its component, as far as ``LINKS`` links show it.

    Only a page of more links is ``parted``: its components may go on in other parts.
    """
    limit = LINKS

    def stars(part, parted):
        key, run, other = (part.column(c).to_numpy() for c in ("key", "run", "other"))
        page = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        size = max(int(run.max()), int(other.max())) + 1
        nodes, at, inverse = np.unique(np.concatenate([page * size + run, page * size + other]), return_index=True, return_inverse=True)
        least = nodes[least_of(inverse[: len(run)], inverse[len(run) :], len(nodes))] % size
        pages = part.column("page_id").take(pa.array(at % len(run))).combine_chunks()
        columns = pages, pa.array((nodes % size).astype(np.int64)), pa.array(least.astype(np.int64)), pa.array(np.full(len(nodes), parted))
        return pa.RecordBatch.from_arrays([*columns], ["page_id", "run", "other", "parted"])

    def run(batches):
        held, part_of = None, None  # links of whole pages, but for the last; the page that is taken in parts
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            if held.num_rows < limit:
                continue
            key = held.column("key").to_numpy()
            if part_of is not None:  # the rest of a page of which parts have gone
                rest = int(np.argmax(key != part_of)) if key[-1] != part_of else len(key)
                if rest:
                    yield stars(held.slice(0, rest), True)
                held, key, part_of = held.slice(rest), key[rest:], part_of if rest == len(key) else None
                if not held.num_rows:
                    continue
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if last:
                yield stars(held.slice(0, last), False)
                held, key = held.slice(last), key[last:]
            if held.num_rows >= limit:
                yield stars(held, True)
                held, part_of = held.slice(0, 0), key[-1]
        if held is not None and held.num_rows:
            key = held.column("key").to_numpy()
            rest = 0 if part_of is None else int((key == part_of).sum())
            if rest:
                yield stars(held.slice(0, rest), True)
            if rest < held.num_rows:
                yield stars(held.slice(rest), False)

    own = links.select("page_id", F.col("run").cast("long").alias("run"), F.col("other").cast("long").alias("other"), F.xxhash64("page_id").alias("key"))
    own = own.repartition(n, "page_id").sortWithinPartitions("key", "page_id", "run")
    schema = own.select("page_id", "run", "other", F.lit(True).alias("parted")).schema
    return own.mapInArrow(run, schema)


def labelled(runs: DataFrame, connectivity: int = 8) -> DataFrame:
    """``runs`` with ``label``, the first run of each run's component.

    Runs in neighbouring rows touch where they overlap, with connectivity 8
    also where they meet at a corner.  A task labels whole pages, as far as it
    can hold their links, and one round gives all runs these labels; where a
    page has more links, further rounds go over what its parts
    found.  Each round takes the least label among
    neighbours and then that label's own label, so rounds are few; each is
    written to the shared folder and the one before deleted.  A round deals
    labels and links by page once, and all of its joins take them so.
    """
    runs = kept(runs.filter("page_id is not null and run is not null"))
    n = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // RUNS))
    by_page = runs.repartition(n, "page_id")
    down = touching(by_page, 1 if connectivity == 8 else 0)
    with dealt_once(runs.sparkSession):
        found = kept(contracted(down, n))
        whole = found.filter("parted").isEmpty()
        stars = found.filter("run <> other").select("page_id", *(F.col(c).cast(runs.schema["run"].dataType).alias(c) for c in ("run", "other")))
        links = stars.unionByName(stars.select("page_id", F.col("other").alias("run"), F.col("run").alias("other")))
        own, labels = None, by_page.select("page_id", "run", F.col("run").alias("label"))
        while True:
            near = links.repartition(n, "page_id").join(labels.select("page_id", F.col("run").alias("other"), F.col("label").alias("theirs")), ["page_id", "other"]).groupBy("page_id", "run").agg(F.min("theirs").alias("theirs"))
            next_ = labels.join(near, ["page_id", "run"], "left").select("page_id", "run", F.col("label").alias("old"), F.least("label", F.coalesce("theirs", "label")).alias("label"))
            jump = next_.select("page_id", F.col("run").alias("label"), F.col("label").alias("further"))
            next_ = kept(next_.join(jump, ["page_id", "label"]).select("page_id", "run", "old", F.col("further").alias("label")))
            if own is not None:
                dropped(own)
            own, labels = next_, next_.drop("old").repartition(n, "page_id")
            if whole or own.filter("old <> label").isEmpty():
                dropped(links)
                return runs.join(own.drop("old"), ["page_id", "run"])


def components(labels: DataFrame) -> DataFrame:
    """``page_id comp l t r b px``: box and pixels of each component, numbered by their first pixel."""
    own = labels.groupBy("page_id", "label").agg(F.min("l").alias("l"), F.min("y").alias("t"), F.max("r").alias("r"), (F.max("y") + 1).alias("b"), F.sum(F.col("r") - F.col("l")).alias("px"))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("label")) - 1
    return own.select("page_id", "label", number.alias("comp"), "l", "t", "r", "b", "px")


def selected(labels: DataFrame, width: int, height: int) -> DataFrame:
    """Runs of the components that are at least so wide and so high."""
    kept = components(labels).filter((F.col("r") - F.col("l") >= width) & (F.col("b") - F.col("t") >= height)).select("page_id", "label")
    return labels.join(kept, ["page_id", "label"], "left_semi")


def filled(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Runs of the components that hold a seed pixel (``page_id y x``): the seeds' flood within the mask."""
    hit = labels.join(seeds, ["page_id", "y"]).filter((F.col("x") >= F.col("l")) & (F.col("x") < F.col("r"))).select("page_id", "label").distinct()
    return labels.join(hit, ["page_id", "label"], "left_semi")
