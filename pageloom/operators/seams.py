"""Rows of text beside large initials: how far a row reaches, where it begins once letters lost to an initial are taken back, and initials by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import sorted_out
from .page import initials

#: Fixed value: share of a row's height that an initial beside it must cover.
COVERED = 0.5
#: Height of the strips in which rows and initials meet; it shapes the work, not the result.
STRIP = 64


def reaches(spans: DataFrame) -> DataFrame:
    """``page_id row reach`` of rows with two spans (page_id row l r) at least: half the mean step between their centres."""
    order = Window.partitionBy("page_id", "row").orderBy("l", "r")
    step = F.greatest(F.expr("(l + r - before) div 2"), F.lit(0))
    own = spans.withColumn("before", F.lag(F.col("l") + F.col("r")).over(order)).filter("before is not null")
    mean = (F.sum(step).cast("float") / F.count("*").cast("float")).cast("float")
    return own.groupBy("page_id", "row").agg((mean / F.lit(2.0).cast("float")).cast("float").alias("reach"))


def extended_left(rows: DataFrame, spans: DataFrame, caps: DataFrame) -> DataFrame:
    """``page_id row cap left``: rows that begin further left, beside the initial that covers most of them.

    ``rows``: page_id row left bottom top reach, with y upwards; ``caps``:
    page_id cap l b r t.  Rows and initials meet in strips of the page, so that
    those at different heights are not compared.  A row moves by its median
    glyph width or its reach at most, and not beyond the initial's left edge.
    """
    width = spans.groupBy("page_id", "row").agg(F.expr("percentile(r - l, 0.5)").cast("float").alias("width"), F.count("*").alias("n")).filter("n >= 2")
    strips = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / STRIP), F.floor(F.col(hi) / STRIP))).alias("strip")
    own = rows.filter((F.col("top") > F.col("bottom")) & (F.col("reach") > 0) & (F.col("reach") < float("inf"))).select("*", strips("bottom", "top"))
    near = caps.filter("t >= b").select("page_id", "cap", "l", "b", "r", "t", strips("b", "t"))
    met = own.join(near, ["page_id", "strip"]).filter((F.abs(F.col("left") - F.col("r")) <= F.col("reach")))
    overlap = (F.least(F.col("t").cast("float"), F.col("top").cast("float")) - F.greatest(F.col("b").cast("float"), F.col("bottom").cast("float"))).cast("float")
    met = met.withColumn("overlap", overlap).filter(F.col("overlap") >= F.lit(COVERED).cast("float") * (F.col("top") - F.col("bottom")).cast("float"))
    best = met.groupBy("page_id", "row", "left", "reach").agg(F.max_by(F.struct("cap", "l", "r"), F.struct("overlap", -F.col("l"), -F.col("cap"))).alias("c")).join(width, ["page_id", "row"])
    moved = F.greatest(F.least("left", F.col("c.r")) - F.round(F.least("reach", "width")).cast("int"), F.col("c.l"), F.lit(0))
    return best.select("page_id", "row", "c.cap", "left", moved.alias("new")).filter("new < left").select("page_id", "row", "cap", F.col("new").alias("left"))


def initials_by_page(components: DataFrame) -> DataFrame:
    """``page_id n``: large initials among a page's components (page_id comp l t r b px), after they are sorted out; 0 for a page without any."""
    own = sorted_out(components)[0].filter("class in ('blob', 'large')").select("page_id", F.col("comp").alias("box"), "w", "h", (F.col("class") == "large").alias("large"))
    found = initials(own).groupBy("page_id").agg(F.count("*").alias("n"))
    return components.select("page_id").distinct().join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n"))
