"""Recursive cutting of pages into blocks, all pages and all branches level by level.

Ink is a relation of disjoint rectangles (page_id l t r b, right and bottom
exclusive): runs of pixels, components or words.  A frontier rectangle is the
set of ink rows that share a ``path``, whose parts sort into reading order.
Each level finds the gaps along both axes of every frontier rectangle at once
and deals its ink rows to the children; rectangles without a cut leave as
leaves.  A level is written to the shared folder before the next; it deals its
ink rows by page once, and all that it does with them takes them so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import axis_cuts
from .shared import dealt_once, dropped, kept

RECT = ("page_id", "path")
EDGES = ("left", "top", "right", "bottom")
#: Ink rows that a task takes in a level; the number of tasks is given to Spark, which would merge them by their packed size.
INK = 1 << 18


def _spans(ink: DataFrame, ink_share: float) -> DataFrame:
    """``page_id path axis s e``: where columns (axis v) and rows (h) of the rectangles hold ink, in parts that may overlap.

    With a share above 0, a column counts whose ink takes more than that share
    of the rectangle's extent across: a sweep over the ends of the ink rows.
    """
    side = lambda axis, s, e, high, a, b: F.struct(F.lit(axis).alias("axis"), F.col(s).alias("s"), F.col(e).alias("e"), (F.col(high[1]) - F.col(high[0])).alias("ink"), (F.col(b) - F.col(a)).alias("extent"))
    own = ink.select(*RECT, F.inline(F.array(side("v", "l", "r", ("t", "b"), "top", "bottom"), side("h", "t", "b", ("l", "r"), "left", "right"))))
    if ink_share == 0:
        return own.select(*RECT, "axis", "s", "e")
    step = lambda at, sign: F.struct(F.col(at).alias("s"), (sign * F.col("ink")).alias("d"))
    steps = own.select(*RECT, "axis", "extent", F.inline(F.array(step("s", 1), step("e", -1)))).groupBy(*RECT, "axis", "extent", "s").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*RECT, "axis").orderBy("s")
    held = steps.withColumn("ink", F.sum("d").over(order)).withColumn("e", F.lead("s").over(order))
    return held.filter((F.col("ink").cast("float") / F.col("extent").cast("float")).cast("float") > F.lit(ink_share).cast("float")).select(*RECT, "axis", "s", "e")


def cuts(ink: DataFrame, share: float = 0.015, least: int = 24, ink_share: float = 0.0) -> DataFrame:
    """``page_id path axis at``: the cuts of each rectangle, along the axis with the thickest gap; equal ones go to the vertical axis.

    Rectangles with a side below ``least`` are not cut.  Narrow gutters of
    columns count together, but not gaps between lines.
    """
    ink = ink.filter((F.col("right") - F.col("left") >= least) & (F.col("bottom") - F.col("top") >= least))
    extent = lambda axis, a, b: F.struct(F.lit(axis).alias("axis"), (F.col(b) - F.col(a)).alias("extent"))
    extents = ink.select(*RECT, *EDGES).distinct().select(*RECT, F.inline(F.array(extent("v", "left", "right"), extent("h", "top", "bottom"))))
    found = axis_cuts(_spans(ink, ink_share), extents, share, least, F.col("axis") == "v", (*RECT, "axis"))
    best = found.groupBy(*RECT, "axis").agg(F.max("thickness").alias("thickness"), F.sort_array(F.collect_list("cut")).alias("at"))  # no more than a page's side holds
    return best.groupBy(*RECT).agg(F.max(F.struct("thickness", "axis", "at")).alias("x")).select(*RECT, "x.axis", "x.at")


def dealt(ink: DataFrame, found: DataFrame) -> DataFrame:
    """Ink rows of the cut rectangles, each in its child; one that lies across a cut is parted."""
    upright = F.col("axis") == "v"
    lo, hi = F.when(upright, F.col("left")).otherwise(F.col("top")), F.when(upright, F.col("right")).otherwise(F.col("bottom"))
    s, e = F.when(upright, F.col("l")).otherwise(F.col("t")), F.when(upright, F.col("r")).otherwise(F.col("b"))
    first, last = F.size(F.filter("at", lambda c: c <= F.col("s"))), F.size(F.filter("at", lambda c: c < F.col("e")))
    own = ink.join(found, list(RECT)).withColumn("bounds", F.concat(F.array(lo), "at", F.array(hi))).withColumn("s", s).withColumn("e", e)
    own = own.withColumn("child", F.explode(F.sequence(first, last)))
    own = own.withColumn("from", F.element_at("bounds", F.col("child") + 1)).withColumn("to", F.element_at("bounds", F.col("child") + 2))
    on = lambda axis, new, old: F.when(F.col("axis") == axis, F.col(new)).otherwise(F.col(old)).alias(old)
    clip = lambda axis, old: F.when(F.col("axis") == axis, F.least(F.greatest(F.col(old), F.col("from")), F.col("to"))).otherwise(F.col(old)).alias(old)
    path = F.concat("path", F.lpad(F.col("child").cast("string"), 6, "0")).alias("path")
    return own.select("page_id", path, clip("v", "l"), clip("h", "t"), clip("v", "r"), clip("h", "b"), on("v", "from", "left"), on("h", "from", "top"), on("v", "to", "right"), on("h", "to", "bottom"))


def boxes(ink: DataFrame) -> DataFrame:
    """The tight box of each rectangle's ink."""
    return ink.groupBy(*RECT).agg(*(f(c).cast("int").alias(c) for f, c in ((F.min, "l"), (F.min, "t"), (F.max, "r"), (F.max, "b"))))


def xy_cut(ink: DataFrame, pages: DataFrame, depth: int = 6, share: float = 0.015, least: int = 24, ink_share: float = 0.0, whole: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``page_id leaf l t r b``: tight boxes of the leaves, numbered from 0 in reading order.

    ``pages``: page_id w h.  ``whole`` gets the rectangles of a level (page_id
    path left top right bottom) and returns those that are not to be cut, such
    as ruled tables.  A page without ink has no leaves.
    """
    size = pages.select("page_id", F.lit("").alias("path"), F.lit(0).alias("left"), F.lit(0).alias("top"), F.col("w").cast("int").alias("right"), F.col("h").cast("int").alias("bottom"))
    own = ink.filter("r > l and b > t").join(size, "page_id").select("page_id", "path", *(F.col(c).cast("int").alias(c) for c in "ltrb"), *EDGES)
    leaves, spent, spark = None, [], ink.sparkSession
    least_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with dealt_once(spark):
        for level in range(depth + 1):
            own = kept(own)
            n = max(least_tasks, -(-own.count() // INK))
            by_page = open_ = own.repartition(n, "page_id")
            if whole is not None:
                open_ = by_page.join(whole(own.select(*RECT, *EDGES).distinct()).select(*RECT), list(RECT), "left_anti")
            found = kept(cuts(open_, share, least, ink_share)) if level < depth else None
            cut = None if found is None else found.repartition(n, "page_id")
            done = kept(boxes(by_page if cut is None else by_page.join(cut, list(RECT), "left_anti")))
            leaves = done if leaves is None else leaves.unionByName(done)
            dropped(*spent)
            if found is None or found.isEmpty():
                break
            spent, own = [own, found], dealt(by_page, cut)
    return leaves.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("path")) - 1).alias("leaf"), "l", "t", "r", "b")
