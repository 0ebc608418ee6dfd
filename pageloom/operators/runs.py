"""Binary pages as runs of ink: ``page_id w h y l r`` (r exclusive), disjoint in each row and not touching.

Every row carries its page's size.  ``page_id`` may be a struct, so that parts
of a page can be pages of their own.  A step along the rows is arithmetic on
run ends and one ordered sweep; a step across them goes over the transposed
page.  Work grows with runs and ink, not with the size of a brick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import components
from .shared import kept

SIZE = ("page_id", "w", "h")
ROW = (*SIZE, "y")


def merged(spans: DataFrame, gap: int = 0) -> DataFrame:
    """Runs of rows whose spans may overlap; those with at most ``gap`` pixels between them become one."""
    order = Window.partitionBy(*ROW).orderBy("l", "r")
    reach = F.max("r").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = spans.filter("r > l").withColumn("new", F.coalesce(F.col("l") > reach + gap, F.lit(True)).cast("int"))
    own = own.withColumn("run", F.sum("new").over(order))
    return own.groupBy(*ROW, "run").agg(F.min("l").cast("int").alias("l"), F.max("r").cast("int").alias("r")).drop("run")


def of_boxes(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """The runs of filled boxes (page_id l t r b) on pages (page_id w h), as far as they lie on them."""
    own = boxes.join(pages.select(*SIZE), "page_id")
    top, bottom = F.greatest(F.col("t"), F.lit(0)), F.least(F.col("b"), F.col("h"))
    own = own.filter(bottom > top).select(*SIZE, F.explode(F.sequence(top, bottom - 1)).alias("y"), "l", "r")
    return merged(own.select(*ROW, F.greatest(F.col("l"), F.lit(0)).alias("l"), F.least(F.col("r"), F.col("w")).alias("r")))


def of_pixels(ink: DataFrame) -> DataFrame:
    """The runs of ink pixels (page_id w h y x), each given once."""
    place = F.col("x") - F.row_number().over(Window.partitionBy(*ROW).orderBy("x"))
    return ink.withColumn("run", place).groupBy(*ROW, "run").agg(F.min("x").cast("int").alias("l"), (F.max("x") + 1).cast("int").alias("r")).drop("run")


def pixels(runs: DataFrame) -> DataFrame:
    return runs.select(*ROW, F.explode(F.sequence("l", F.col("r") - 1)).alias("x"))


def transposed(runs: DataFrame) -> DataFrame:
    """Rows and columns change places."""
    return of_pixels(pixels(runs).select("page_id", F.col("h").alias("w"), F.col("w").alias("h"), F.col("x").alias("y"), F.col("y").alias("x")))


def _grown(runs: DataFrame, before: int, behind: int, clip: bool) -> DataFrame:
    l, r = F.col("l") - before, F.col("r") + behind
    return merged(runs.select(*ROW, (F.greatest(l, F.lit(0)) if clip else l).alias("l"), (F.least(r, F.col("w")) if clip else r).alias("r")))


def _shrunk(runs: DataFrame, before: int, behind: int) -> DataFrame:
    own = runs.select(*ROW, (F.col("l") + before).alias("l"), (F.col("r") - behind).alias("r"))
    return own.filter("r > l")


def _both_ways(runs: DataFrame, w: int, h: int, along) -> DataFrame:
    """``along(runs, size)`` on rows and on columns, whichever the brick has a length in."""
    if w > 1:
        runs = along(runs, w)
    return transposed(along(transposed(runs), h)) if h > 1 else runs


def dilated(runs: DataFrame, w: int, h: int, clip: bool = True) -> DataFrame:
    """Ink where a w x h brick, its origin at half its size, put on an ink pixel reaches."""
    return _both_ways(runs, w, h, lambda own, n: _grown(own, n // 2, n - 1 - n // 2, clip))


def eroded(runs: DataFrame, w: int, h: int) -> DataFrame:
    """Ink where all of the brick is ink; outside is paper."""
    return _both_ways(runs, w, h, lambda own, n: _shrunk(own, n // 2, n - 1 - n // 2))


def opened(runs: DataFrame, w: int, h: int) -> DataFrame:
    """Along one axis alone, the runs of the brick's length and more."""
    if w == 1 or h == 1:
        return _both_ways(runs, w, h, lambda own, n: own.filter(F.col("r") - F.col("l") >= n))
    return dilated(eroded(runs, w, h), w, h)


def closed(runs: DataFrame, w: int, h: int) -> DataFrame:
    """Closing as if paper went on beyond the page; along one axis alone, gaps shorter than the brick are filled."""
    if w == 1 or h == 1:
        return _both_ways(runs, w, h, lambda own, n: merged(own, n - 1))
    return eroded(dilated(runs, w, h, clip=False), w, h)


def combined(a: DataFrame, b: DataFrame, rule) -> DataFrame:
    """Ink where ``rule(a, b)`` holds, of columns that say whether each page has ink there; nothing where neither has."""
    step = lambda at, x, y: F.struct(F.col(at).alias("x"), F.lit(x).alias("a"), F.lit(y).alias("b"))
    steps = a.select(*ROW, F.inline(F.array(step("l", 1, 0), step("r", -1, 0)))).unionByName(b.select(*ROW, F.inline(F.array(step("l", 0, 1), step("r", 0, -1)))))
    steps = steps.groupBy(*ROW, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(*ROW).orderBy("x")
    own = steps.select(*ROW, F.col("x").alias("l"), F.lead("x").over(order).alias("r"), (F.sum("a").over(order) > 0).alias("a"), (F.sum("b").over(order) > 0).alias("b"))
    return merged(own.filter(F.col("r").isNotNull() & (F.col("a") | F.col("b")) & rule(F.col("a"), F.col("b"))).drop("a", "b"))


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    return merged(a.unionByName(b))


def subtracted(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined(a, b, lambda x, y: x & ~y)


def full(pages: DataFrame) -> DataFrame:
    """Pages (page_id w h) of nothing but ink."""
    return pages.filter("w > 0 and h > 0").select(*SIZE, F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), F.lit(0).alias("l"), F.col("w").alias("r"))


def inverted(runs: DataFrame, pages: DataFrame) -> DataFrame:
    return subtracted(full(pages), runs)


def halved(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.expr("w div 2").cast("int").alias("w"), F.expr("h div 2").cast("int").alias("h"))


def rank_reduced(runs: DataFrame, level: int) -> DataFrame:
    """Ink where at least ``level`` pixels of a 2 x 2 box are; an odd edge is dropped.

    One or all four go by run ends, two and three by pixels of ink.
    """
    half = lambda c: F.expr(f"{c} div 2").cast("int").alias(c)
    own = runs.withColumn("r", F.least(F.col("r"), F.col("w") - F.col("w") % 2)).filter("y < h - h % 2 and r > l")
    size = ("page_id", half("w"), half("h"))
    if level == 1:
        return merged(own.select(*size, half("y"), half("l"), F.expr("(r + 1) div 2").alias("r")))
    if level == 4:
        inner = own.select(*size, "y", F.expr("(l + 1) div 2").alias("l"), half("r")).filter("r > l")
        upper, lower = (inner.filter(F.col("y") % 2 == k).withColumn("y", half("y")) for k in (0, 1))
        return combined(upper, lower, lambda a, b: a & b)
    boxes = pixels(own).groupBy(*size, half("y"), half("x")).count()
    return of_pixels(boxes.filter(F.col("count") >= level).drop("count"))


def replicated(runs: DataFrame, n: int) -> DataFrame:
    """Each pixel ``n`` times in both directions."""
    y = F.explode(F.sequence(F.col("y") * n, F.col("y") * n + n - 1)).alias("y")
    return runs.select("page_id", *((F.col(c) * n).alias(c) for c in ("w", "h")), y, *((F.col(c) * n).alias(c) for c in ("l", "r")))


def numbered(runs: DataFrame) -> DataFrame:
    """``runs`` with ``run``, their number on the page in raster order."""
    return runs.withColumn("run", F.row_number().over(Window.partitionBy("page_id").orderBy("y", "l")))


def labelled(runs: DataFrame, connectivity: int = 8) -> DataFrame:
    """``runs`` with ``label``, the number of the first run of each run's component."""
    own = kept(numbered(runs))
    labels = components.labelled(own.select("page_id", "run", "y", "l", "r"), connectivity).select("page_id", "run", "label")
    return own.join(labels, ["page_id", "run"]).drop("run")


def boxes(labels: DataFrame) -> DataFrame:
    """``page_id label l t r b px``: box and pixels of each component."""
    return labels.groupBy(*SIZE, "label").agg(F.min("l").alias("l"), F.min("y").alias("t"), F.max("r").alias("r"), (F.max("y") + 1).alias("b"), F.sum(F.col("r") - F.col("l")).alias("px"))


def counted(runs: DataFrame, connectivity: int = 8, where: Column | None = None) -> DataFrame:
    """``page_id n``: each page's components, or those whose boxes (l t r b px) fulfil ``where``."""
    own = boxes(labelled(runs, connectivity))
    return (own if where is None else own.filter(where)).groupBy("page_id").agg(F.count("*").alias("n"))


def seed_filled(seeds: DataFrame, mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """The components of ``mask`` that hold ink of ``seeds``."""
    labels = kept(labelled(mask, connectivity))
    hit = combined(seeds, labels, lambda a, b: a & b)
    # a common part begins inside one run of the mask: the last that begins at or before it
    mark = lambda df, kind, label: df.select(*ROW, "l", F.lit(kind).alias("kind"), label.alias("label"))
    both = mark(labels, 0, F.col("label")).unionByName(mark(hit, 1, F.lit(None).cast("int")))
    last = F.last("label", ignorenulls=True).over(Window.partitionBy(*ROW).orderBy("l", "kind").rowsBetween(Window.unboundedPreceding, 0))
    held = both.withColumn("label", last).filter("kind = 1").select("page_id", "label").distinct()
    return labels.join(held, ["page_id", "label"], "left_semi").select(*ROW, "l", "r")


def by_component(runs: DataFrame, step, connectivity: int = 8, width: int = 1, height: int = 1) -> DataFrame:
    """``step`` on each component by itself, within its own box; smaller ones than ``width`` or ``height`` are dropped."""
    labels = kept(labelled(runs, connectivity))
    own = boxes(labels).filter((F.col("r") - F.col("l") >= width) & (F.col("b") - F.col("t") >= height))
    own = own.select("page_id", "label", F.col("l").alias("x0"), F.col("t").alias("y0"), (F.col("r") - F.col("l")).alias("cw"), (F.col("b") - F.col("t")).alias("ch"))
    part = F.struct("page_id", "label", "x0", "y0", "w", "h").alias("page_id")
    parts = labels.join(own, ["page_id", "label"]).select(part, F.col("cw").alias("w"), F.col("ch").alias("h"), (F.col("y") - F.col("y0")).alias("y"), (F.col("l") - F.col("x0")).alias("l"), (F.col("r") - F.col("x0")).alias("r"))
    done = step(parts).filter("y < h and l < w")
    key = lambda c: F.col(f"page_id.{c}")
    back = done.select(key("page_id").alias("page_id"), key("w").alias("w"), key("h").alias("h"), (F.col("y") + key("y0")).alias("y"), (F.col("l") + key("x0")).alias("l"), (F.least("r", "w") + key("x0")).alias("r"))
    return merged(back)


def selected(runs: DataFrame, where: Column, connectivity: int = 8) -> DataFrame:
    """The components whose boxes (l t r b px) fulfil ``where``."""
    labels = kept(labelled(runs, connectivity))
    return labels.join(boxes(labels).filter(where).select("page_id", "label"), ["page_id", "label"], "left_semi").select(*ROW, "l", "r")
