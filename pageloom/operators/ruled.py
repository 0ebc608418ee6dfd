"""Ruled tables: rules found by long openings, taken off the page and repainted, and the score by which a region is a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runs as R
from . import sheets as S
from .shared import kept
from .xycut import EDGES

#: Length of a rule and of a corridor, gap within a rule, width of a corridor at half size, least side of a table, least score.
RULE, RULE_GAP, CORRIDOR, CORRIDOR_WIDTH, SIDE, SCORE = 100, 4, 100, 5, 100, 2


def rules(ink: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long horizontal and long vertical runs, mended across small gaps."""
    return kept(R.closed(R.opened(ink, RULE, 1), 1, RULE_GAP)), kept(R.closed(R.opened(ink, 1, RULE), RULE_GAP, 1))


def without_rules(ink: DataFrame, lines: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The page without the components that hold a rule."""
    across, down = lines or rules(ink)
    return R.subtracted(ink, R.seed_filled(R.united(across, down), ink))


def decided(ink: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id nhb nvb nvw score`` of every page: horizontal and vertical rules, white corridors, and how many of four signs hold."""
    ink = kept(ink)
    across, down = lines = rules(ink)
    text = R.opened(R.closed(without_rules(ink, lines), 4, 1), 8, 1)
    # half size; a place is white if any of its four pixels is, so text is where all are; columns lie as rows
    solid, half = R.transposed(R.rank_reduced(text, 4)), R.halved(pages).select("page_id", F.col("h").alias("w"), F.col("w").alias("h"))
    corridors = R.inverted(solid, half).filter(F.col("r") - F.col("l") >= CORRIDOR)
    counts = [(across, "nhb", None), (down, "nvb", None), (corridors, "nvw", F.col("b") - F.col("t") >= CORRIDOR_WIDTH)]
    out = pages.select("page_id")
    for own, name, where in counts:
        out = out.join(R.counted(own, where=where).withColumnRenamed("n", name), "page_id", "left")
    out = out.select("page_id", *(F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("nhb", "nvb", "nvw")))
    return _scored(out)


def _decided(ink: np.ndarray) -> tuple[int, int, int]:
    across, down = _rules(ink)
    text = S.opened(S.closed(ink & ~S.seed_filled(across | down, ink, 8), 4, 1), 8, 1)
    return S.counted(across), S.counted(down), S.counted(S.opened(~S.rank_reduced(text, 4), 1, CORRIDOR), CORRIDOR_WIDTH)


def _rules(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return S.closed(S.opened(ink, RULE, 1), 1, RULE_GAP), S.closed(S.opened(ink, 1, RULE), RULE_GAP, 1)


def _scored(out: DataFrame) -> DataFrame:
    signs = ("nhb > 1", "nvb > 2", "nvw > 3", "nvw > 6")
    return out.withColumn("score", sum((F.expr(s).cast("int") for s in signs), F.lit(0)))


def whole_decided(sheets: DataFrame) -> DataFrame:
    """``decided`` of whole pages."""
    return _scored(S.each(sheets, lambda ink: tuple(np.array([n]) for n in _decided(ink)), "nhb", "nvb", "nvw"))


def whole_without_rules(sheets: DataFrame) -> DataFrame:
    """``page_id l t r b``: the ink of whole pages without the components that hold a rule, in boxes of equal runs one below the other."""

    def boxes(ink: np.ndarray):
        across, down = _rules(ink)
        own = S.Runs(ink & ~S.seed_filled(across | down, ink, 8))
        order = np.lexsort((own.y, own.r, own.l))
        l, r, y = own.l[order], own.r[order], own.y[order]
        first = np.flatnonzero(np.concatenate([[True], (l[1:] != l[:-1]) | (r[1:] != r[:-1]) | (y[1:] != y[:-1] + 1)])[: len(l)])
        return l[first], y[first], r[first], y[np.append(first[1:], len(l)) - 1] + 1 if len(l) else y

    return S.each(sheets, boxes, *"ltrb")


def tables_whole(sheets: DataFrame, rects: DataFrame) -> DataFrame:
    """``whole_tables`` of whole pages: ``page_id path`` of the rectangles that are tables on the sheets of the pages as printed."""
    large = rects.filter(F.least(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")) >= SIDE)

    def scored(ink: np.ndarray, left: int, top: int, right: int, bottom: int):
        part = ink[max(top, 0) : max(bottom, 0), max(left, 0) : max(right, 0)]
        if min(part.shape) < SIDE:
            return (np.empty(0),)
        nhb, nvb, nvw = _decided(part)
        score = np.array([(nhb > 1) + (nvb > 2) + (nvw > 3) + (nvw > 6)])
        return (score[score >= SCORE],)

    return S.each(large.join(sheets, "page_id"), scored, "score", given=EDGES, keep=("page_id", "path")).select("page_id", "path")


def cropped(ink: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions (page_id region l t r b) as pages of their own, whose ``page_id`` is a struct of both ids; and their sizes."""
    own = regions.join(ink.select("page_id", "w", "h").distinct(), "page_id")
    l, t = F.greatest(F.col("l"), F.lit(0)), F.greatest(F.col("t"), F.lit(0))
    own = own.select("page_id", "region", l.alias("x0"), t.alias("y0"), F.least("r", "w").alias("x1"), F.least("b", "h").alias("y1")).filter("x1 > x0 and y1 > y0")
    key = F.struct("page_id", "region").alias("page_id")
    sizes = own.select(key, (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    met = ink.drop("w", "h").join(own, "page_id").filter("y >= y0 and y < y1 and r > x0 and l < x1")
    parts = met.select(key, (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), (F.col("y") - F.col("y0")).alias("y"), (F.greatest("l", "x0") - F.col("x0")).alias("l"), (F.least("r", "x1") - F.col("x0")).alias("r"))
    return parts, sizes


def tables(ink: DataFrame, regions: DataFrame, ruled: bool = False) -> DataFrame:
    """``page_id region`` of the regions that are tables, and with ``ruled`` show rules; smaller ones than ``SIDE`` never are."""
    large = regions.filter((F.least(F.col("r") - F.col("l"), F.col("b") - F.col("t")) >= SIDE))
    parts, sizes = cropped(ink, large)
    sizes = sizes.filter((F.col("w") >= SIDE) & (F.col("h") >= SIDE))
    found = decided(parts, sizes).filter(F.col("score") >= SCORE)
    found = found.filter(has_rules()) if ruled else found
    return found.select("page_id.page_id", "page_id.region")


def whole_tables(ink: DataFrame, rects: DataFrame) -> DataFrame:
    """``page_id path`` of the rectangles (page_id path left top right bottom) that are tables: the ``whole`` of recursive cuts.

    ``ink`` is the page as printed, with its rules, whatever page is cut.
    """
    regions = rects.select("page_id", F.col("path").alias("region"), F.col("left").alias("l"), F.col("top").alias("t"), F.col("right").alias("r"), F.col("bottom").alias("b"))
    return tables(ink, regions).withColumnRenamed("region", "path")


def has_rules() -> Column:
    return (F.col("nhb") > 1) | (F.col("nvb") > 2)


def repainted(px: DataFrame, ink: DataFrame, kept_ink: DataFrame) -> DataFrame:
    """Pixels ``page_id y x v`` with ink that ``kept_ink`` lacks painted in its row's background: the upper median of the pixels that are no ink, else the page's, else white."""
    spots = lambda runs, name: R.pixels(runs).select("page_id", "y", "x", F.lit(True).alias(name))
    own = px.join(spots(ink, "ink"), ["page_id", "y", "x"], "left").join(spots(R.subtracted(ink, kept_ink), "gone"), ["page_id", "y", "x"], "left")
    hist = own.filter("ink is null").groupBy("page_id", "y", "v").agg(F.count("*").alias("c"))
    by_row, by_page = upper_median(hist, "page_id", "y"), upper_median(hist.groupBy("page_id", "v").agg(F.sum("c").alias("c")), "page_id").withColumnRenamed("median", "page_median")
    rows = own.filter("gone").select("page_id", "y").distinct().join(by_row, ["page_id", "y"], "left").join(by_page, "page_id", "left")
    rows = rows.select("page_id", "y", F.coalesce("median", "page_median", F.lit(255)).alias("fill"))
    own = own.join(rows, ["page_id", "y"], "left")
    return own.select("page_id", "y", "x", F.when(F.col("gone"), F.col("fill")).otherwise(F.col("v")).alias("v"))


def upper_median(hist: DataFrame, *keys: str) -> DataFrame:
    """``median`` of each key from its histogram (v, c): the value at half the count, counted from 0."""
    key = Window.partitionBy(*keys)
    own = hist.withColumn("upto", F.sum("c").over(key.orderBy("v"))).withColumn("n", F.sum("c").over(key))
    return own.filter("upto > n div 2").groupBy(*keys).agg(F.min("v").alias("median"))
