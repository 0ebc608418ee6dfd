"""Small page operators: colour, turns, crops, ink flags, histogram quantiles, first extremes and large initials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of red, green and blue in luminance.
LUMINANCE = (0.3, 0.5, 0.2)


def grey(red: Column, green: Column, blue: Column, weights: tuple[float, float, float] = (0, 0, 0)) -> Column:
    """Weighted sum in single precision, rounded; weights are brought to a sum of 1, and none at all stands for luminance."""
    own = weights if any(weights) else LUMINANCE
    total = sum(own)
    own = tuple(w / total for w in own) if abs(total - 1) > 0.0001 else own
    single = lambda c: c.cast("float")
    parts = [single(single(F.lit(w)) * single(c)) for w, c in zip(own, (red, green, blue), strict=True)]
    return single(parts[0] + parts[1] + parts[2] + single(F.lit(0.5))).cast("int")


def turned_back(px: DataFrame, width: int) -> DataFrame:
    """Rotated by 90 degrees counter-clockwise."""
    return px.select("page_id", (width - 1 - F.col("x")).alias("y"), F.col("y").alias("x"), "v")


def cropped(rows: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """The part of each page inside a box (right and bottom exclusive), as far as it lies on the page; filters rows first."""
    left, top = max(left, 0), max(top, 0)
    own = rows.filter((F.col("y") >= top) & (F.col("y") < bottom))
    return own.select("page_id", (F.col("y") - top).alias("y"), F.slice("v", left + 1, max(right - left, 0)).alias("v")).filter("size(v) > 0")


def mirrored(rows: DataFrame, n: int) -> DataFrame:
    """``n`` pixels around the page, mirrored at its edges, which are doubled; a page narrower or lower than ``n`` has no such border and is left out."""
    page = Window.partitionBy("page_id")
    last = F.max("y").over(page)
    rows = rows.withColumn("fits", (F.min(F.size("v")).over(page) >= n) & (last + 1 >= n)).filter("fits").drop("fits")
    wide = F.concat(F.reverse(F.slice("v", 1, n)), "v", F.reverse(F.slice("v", F.size("v") - n + 1, n)))
    y, end = F.col("y"), F.col("last")
    places = F.filter(F.array(y + n, F.when(y < n, n - 1 - y), F.when(y > end - n, 2 * end + 1 - y + n)), lambda p: p.isNotNull())
    return rows.withColumn("last", last).select("page_id", F.explode(places).alias("y"), wide.alias("v"))


def ink_flags(bits: DataFrame, axis: str, share: float) -> DataFrame:
    """``page_id``, the place along ``axis`` (x or y) and whether more than ``share`` of its pixels are ink."""
    part = (F.sum("ink").cast("float") / F.count("*").cast("float")).cast("float")
    return bits.groupBy("page_id", F.col(axis).alias("at")).agg((part > F.lit(share).cast("float")).alias("inked"))


def interpolated(hist: DataFrame, fraction: float) -> DataFrame:
    """Quantile ``page_id ile`` of a histogram (v, c): the end of the first bucket that reaches the share, less what it has too much.

    The share is that of one value at least.
    """
    up = Window.partitionBy("page_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("c").over(Window.partitionBy("page_id"))
    own = hist.withColumn("sum", F.sum("c").over(up)).withColumn("target", F.greatest(F.lit(1.0), F.lit(fraction) * n)).filter("sum >= target")
    first = own.groupBy("page_id").agg(F.min_by(F.struct("v", "c", "sum", "target"), "v").alias("b"))
    return first.select("page_id", (F.col("b.v") + 1 - (F.col("b.sum") - F.col("b.target")) / F.col("b.c")).alias("ile"))


def pile(hist: DataFrame, values: DataFrame) -> DataFrame:
    """Count of each asked value (page_id, v) in its page's histogram; values beyond 0 to 255 count as the ends."""
    asked = values.withColumn("v", F.least(F.lit(255), F.greatest(F.lit(0), F.col("v"))))
    return asked.join(hist, ["page_id", "v"], "left").select("page_id", "v", F.coalesce("c", F.lit(0)).alias("c"))


def extremes(scores: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """First greatest and first least value of each key, with their places."""
    return scores.groupBy(key).agg(
        F.max(value).alias("greatest"), F.max_by(at, F.struct(F.col(value), -F.col(at))).alias("greatest_at"), F.min(value).alias("least"), F.min_by(at, F.struct(F.col(value), F.col(at))).alias("least_at")
    )


def initials(boxes: DataFrame) -> DataFrame:
    """Boxes (page_id box w h large) among the ``large`` ones that have the shape of a large initial.

    Heights of the others set the scale; a page with fewer than 8 of them has none.
    """
    scale = boxes.filter("not large").groupBy("page_id").agg(F.count("*").alias("n"), F.avg("h").alias("mean"), F.stddev_pop("h").alias("sd")).filter("n >= 8")
    own = boxes.filter("large and h > 0 and w > 0").join(scale, "page_id")
    high = (F.col("sd") <= 2.0**-23) | ((F.col("h") - F.col("mean")) / F.col("sd") >= 4)
    return own.filter(high & (F.col("h") / F.col("mean")).between(1.8, 6.0) & (F.col("w") / F.col("h")).between(0.25, 1.6)).select("page_id", "box", "w", "h")
