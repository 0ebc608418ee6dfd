"""Masks of a page: pictures (halftone), lines of text, blocks of text; and the figures that pictures make up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runs as R
from . import sheets as S
from .shared import kept

#: Least side of a page that masks are made of, and least side of a block.
SIDE, BLOCK = 100, 60


def large(frame: DataFrame) -> DataFrame:
    return frame.filter((F.col("w") >= SIDE) & (F.col("h") >= SIDE))


def resized(ink: DataFrame, sizes: DataFrame) -> DataFrame:
    """``ink`` on pages of other sizes (page_id w h), clipped."""
    own = ink.drop("w", "h").join(sizes, "page_id").withColumn("r", F.least("r", "w"))
    return own.filter("y < h and l < r").select(*R.ROW, "l", "r")


def pictures(ink: DataFrame, pages: DataFrame) -> DataFrame:
    """The mask of pictures; pages below ``SIDE`` have none.

    What is dense at an eighth of the size is a seed, and grows within the
    closed page.  The mask ends with the last whole box of four pixels.
    """
    ink = kept(large(ink))
    seeds = kept(R.replicated(R.opened(R.rank_reduced(R.rank_reduced(ink, 4), 4), 5, 5), 4))
    sizes = large(pages).select("page_id", F.expr("w div 4 * 4").cast("int").alias("w"), F.expr("h div 4 * 4").cast("int").alias("h"))
    return kept(R.seed_filled(seeds, resized(R.closed(ink, 4, 4), sizes), 4))


def without_pictures(ink: DataFrame, mask: DataFrame, pages: DataFrame) -> DataFrame:
    return kept(R.subtracted(large(ink), resized(mask, large(pages))))


def text_lines(text: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mask of text lines, and the vertical white lanes that part columns."""
    text, pages = kept(large(text)), large(pages)
    paper = kept(R.inverted(text, pages))
    lanes = kept(R.opened(R.opened(R.subtracted(paper, R.opened(paper, 80, 60)), 5, 1), 1, 200))
    return kept(R.opened(R.subtracted(R.closed(text, 30, 1), lanes), 3, 3)), lanes


def text_blocks(lines: DataFrame, lanes: DataFrame) -> DataFrame:
    """The mask of text blocks: lines joined downwards, each made solid by itself, parted by lanes; specks are dropped."""
    joined = kept(R.opened(R.closed(lines, 1, 10), 4, 1))
    solid = R.by_component(joined, lambda part: R.dilated(R.closed(part, 30, 30), 3, 3))
    return kept(R.selected(R.subtracted(R.closed(solid, 10, 1), lanes), F.expr("r - l >= 25 and b - t >= 5")))


def brought_back(mask: DataFrame, ink: DataFrame, pages: DataFrame) -> DataFrame:
    """The mask of pictures that was found at half the size, grown within the page's ink."""
    twice = R.replicated(mask, 2)
    sizes = pages.select("page_id", F.expr("w div 2 div 4 * 8").cast("int").alias("w"), F.expr("h div 2 div 4 * 8").cast("int").alias("h"))
    return kept(R.united(twice, R.seed_filled(twice, resized(ink, sizes), 8)))


def halftone(ink: DataFrame, pages: DataFrame) -> DataFrame:
    """The mask of pictures alone."""
    ink, pages = kept(large(ink)), large(pages)
    return brought_back(pictures(R.rank_reduced(ink, 1), R.halved(pages)), ink, pages)


def regions(ink: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """``halftone``, ``textline`` and ``textblock`` masks, found at half the size and brought back to the page's."""
    ink, pages = kept(large(ink)), large(pages)
    half, size = kept(R.rank_reduced(ink, 1)), R.halved(pages)
    mask = pictures(half, size)
    lines, lanes = text_lines(without_pictures(half, mask, size), size)
    blocks = R.selected(text_blocks(lines, lanes), F.expr(f"r - l >= {BLOCK} or b - t >= {BLOCK}"), 4)
    return {"halftone": brought_back(mask, ink, pages), "textline": kept(R.dilated(R.replicated(lines, 2), 3, 3)), "textblock": kept(R.dilated(R.replicated(blocks, 2), 3, 3))}


KINDS = ("halftone", "textline", "textblock")


def listed(found: dict[str, DataFrame]) -> DataFrame:
    """``page_id mask y l r``: the runs of masks by their names."""
    out = None
    for kind, own in found.items():
        part = own.select("page_id", F.lit(kind).alias("mask"), "y", "l", "r")
        out = part if out is None else out.unionByName(part)
    return out


def _pictures(ink: np.ndarray) -> np.ndarray:
    seeds = S.replicated(S.opened(S.rank_reduced(S.rank_reduced(ink, 4), 4), 5, 5), 4)
    h, w = seeds.shape
    return S.seed_filled(seeds, S.closed(ink, 4, 4)[:h, :w], 4)


def _brought_back(mask: np.ndarray, ink: np.ndarray) -> np.ndarray:
    twice = S.replicated(mask, 2)
    h, w = twice.shape
    return twice | S.seed_filled(twice, ink[:h, :w], 8)


def _text(half: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The masks of text lines and text blocks at half the size."""
    h, w = half.shape
    text = half & ~S.resized(mask, w, h)
    lanes = S.opened(S.opened(~text & ~S.opened(~text, 80, 60), 5, 1), 1, 200)
    lines = S.opened(S.closed(text, 30, 1) & ~lanes, 3, 3)
    joined = S.opened(S.closed(lines, 1, 10), 4, 1)
    solid = S.by_component(joined, lambda part: S.dilated(S.closed(part, 30, 30), 3, 3), 8)
    blocks = S.selected(S.closed(solid, 10, 1) & ~lanes, lambda w, h: (w >= 25) & (h >= 5), 8)
    return lines, S.selected(blocks, lambda w, h: (w >= BLOCK) | (h >= BLOCK), 4)


def _rows(*columns) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([c, []]) for c in columns)


def whole_regions(sheets: DataFrame) -> DataFrame:
    """``regions`` of whole pages, as ``listed``."""

    def masks(ink: np.ndarray):
        half = S.rank_reduced(ink, 1)
        if min(half.shape) < SIDE:
            return _rows([], [], [], [])
        mask = _pictures(half)
        twice = (S.dilated(S.replicated(own, 2), 3, 3) for own in _text(half, mask))
        own = [S.Runs(a) for a in (_brought_back(mask, ink), *twice)]
        return np.repeat(np.arange(len(own)), [len(k.y) for k in own]), *(np.concatenate([getattr(k, c) for k in own]) for c in "ylr")

    own = S.each(sheets, masks, "kind", "y", "l", "r")
    return own.select("page_id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("mask"), "y", "l", "r")


def whole_figures(sheets: DataFrame, least: int = 1) -> DataFrame:
    """``figures`` of whole pages' pictures."""

    def boxes(ink: np.ndarray):
        half = S.rank_reduced(ink, 1)
        if min(half.shape) < SIDE:
            return _rows([], [], [], [], [])
        _, *box = S.Runs(_brought_back(_pictures(half), ink), 8).boxes()
        fit = (box[2] - box[0] >= least) & (box[3] - box[1] >= least)
        return np.arange(fit.sum()), *(c[fit] for c in box)

    return S.each(sheets, boxes, "figure", *"ltrb")


def figures(halftone: DataFrame, least: int = 1) -> DataFrame:
    """``page_id figure l t r b``: boxes of the pictures, numbered in raster order of their first pixel."""
    own = R.boxes(R.labelled(halftone, 8)).filter((F.col("r") - F.col("l") >= least) & (F.col("b") - F.col("t") >= least))
    return own.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("label")) - 1).alias("figure"), "l", "t", "r", "b")
