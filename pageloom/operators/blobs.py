"""Components of a page sorted into blobs of text, noise, small and large ones, by quantiles of their heights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .page import interpolated

#: Height below which a component is noise, share of its box that a solid one fills, greatest height that is told apart.
NOISE, SOLID, TALLEST = 7, 0.7, 599
#: Quantiles of heights, widest blob, and parts of a line's height.
MIDDLE, UPPER, WIDTH, LINE, EXCESS = 0.75, 0.90, 8.0, 1.25, 1.3
DESCENDER, X_HEIGHT, ASCENDER = 0.25, 0.5, 0.25
LINES = (DESCENDER + X_HEIGHT + 2 * ASCENDER) / X_HEIGHT
CAP = X_HEIGHT / (X_HEIGHT + ASCENDER)


def _quantile(pool: DataFrame, pages: DataFrame, fraction: float) -> DataFrame:
    """``page_id ile`` of the heights ``h`` in ``pool``; 0 for a page without any."""
    hist = pool.groupBy("page_id", F.least("h", F.lit(TALLEST)).alias("v")).agg(F.count("*").alias("c"))
    return pages.join(interpolated(hist, fraction), "page_id", "left").select("page_id", F.coalesce("ile", F.lit(0.0)).cast("float").alias("ile"))


def sorted_out(components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``components`` (page_id l t r b px) with ``h w class``; and ``page_id line_size line_spacing max_blob`` of each page.

    First pass: low ones are noise and solid ones small.  The heights of the
    others set limits, by which small ones of a letter's height come back,
    and the rest is parted once more.  No component is lost.
    """
    h, w = (F.col("b") - F.col("t")).cast("int").alias("h"), (F.col("r") - F.col("l")).cast("int").alias("w")
    own = components.withColumns({"h": h, "w": w})
    solid = F.col("px").cast("double") >= (F.col("h") * F.col("w")).cast("double") * SOLID
    own = own.withColumn("class", F.when(F.col("h") < NOISE, "noise").when(solid, "small").otherwise("blob"))
    pages = own.select("page_id").distinct()
    first = _quantile(own.filter("class = 'blob'"), pages, MIDDLE).withColumnRenamed("ile", "x")
    x = F.col("x").cast("double")
    limits = first.select("page_id", "x", F.ceil(x * LINES).alias("max_y"), F.floor(x / 2).alias("min_y"), F.ceil(x * WIDTH).alias("max_x"))
    own = own.join(limits, "page_id")
    low, tall, wide = F.col("h") < F.col("min_y"), F.col("h") > F.col("max_y"), F.col("w") > F.col("max_x")
    small = F.when(tall, "large").when(low, "small").when(wide, "large").otherwise("blob")
    again = F.when(low, "small").when(tall | wide, "large").otherwise("blob")
    own = own.withColumn("class", F.when(F.col("class") == "noise", "noise").when(F.col("class") == "small", small).otherwise(again))
    upper = _quantile(own.filter("class = 'blob'"), pages, UPPER).join(first, "page_id")
    line = F.greatest(F.col("x"), (F.col("ile").cast("double") * CAP).cast("float"))
    lines = upper.select("page_id", F.when(line == 0, F.lit(1.0).cast("float")).otherwise(line).alias("line"))
    size = (F.col("line").cast("double") * LINE).cast("float")
    lines = lines.select("page_id", size.alias("line_size"), (F.col("line").cast("double") * LINES).cast("float").alias("line_spacing"), (size.cast("double") * EXCESS).cast("float").alias("max_blob"))
    return own.drop("x", "max_y", "min_y", "max_x"), lines
