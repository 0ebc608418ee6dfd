"""Raster operators over exploded pixels (page_id y x v); ink: a pixel at or below its page's threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("page_id", "v").agg(F.count("*").alias("c"))


def otsu(px: DataFrame) -> DataFrame:
    """``page_id threshold`` with the greatest between-class variance; the first of equals."""
    hist = histogram(px)
    up = Window.partitionBy("page_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("page_id")
    sums = hist.select(
        "page_id", "v", F.sum("c").over(up).alias("w0"), F.sum(F.col("c") * F.col("v")).over(up).alias("s0"),
        F.sum("c").over(whole).alias("n"), F.sum(F.col("c") * F.col("v")).over(whole).alias("s"),
    ).filter("w0 < n")
    # (mu0 - mu1)^2 * w0 * w1, over n^2, in integers: (s0 * n - s * w0)^2 / (w0 * w1)
    top = F.col("s0") * F.col("n") - F.col("s") * F.col("w0")
    sums = sums.withColumn("score", top.cast("double") * top / (F.col("w0") * (F.col("n") - F.col("w0"))))
    return sums.groupBy("page_id").agg(F.max_by("v", F.struct("score", (-F.col("v")).alias("first"))).alias("threshold"))


def binarized(px: DataFrame) -> DataFrame:
    """``page_id y x ink``; the threshold of a page of one value is -1, so it has no ink."""
    return px.join(otsu(px), "page_id", "left").select("page_id", "y", "x", (F.col("v") <= F.coalesce("threshold", F.lit(-1))).cast("int").alias("ink"))


def integral(px: DataFrame) -> DataFrame:
    """Sums of values and squares over the rectangle from the origin."""
    across = Window.partitionBy("page_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("page_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    rows = px.select("page_id", "y", "x", F.sum("v").over(across).alias("s"), F.sum(F.col("v") * F.col("v")).over(across).alias("q"))
    return rows.select("page_id", "y", "x", F.sum("s").over(down).alias("s"), F.sum("q").over(down).alias("q"))


def halved(px: DataFrame) -> DataFrame:
    """Mean of 2 x 2 boxes; an odd edge is dropped."""
    boxes = px.groupBy("page_id", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return boxes.filter("n = 4").select("page_id", "y", "x", F.shiftright("s", 2).alias("v"))


def rank_reduced(bits: DataFrame, level: int) -> DataFrame:
    """Ink where at least ``level`` of 2 x 2 pixels are ink."""
    boxes = bits.groupBy("page_id", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.sum("ink").alias("s"), F.count("*").alias("n"))
    return boxes.filter("n = 4").select("page_id", "y", "x", (F.col("s") >= level).cast("int").alias("ink"))


def turned(px: DataFrame, height: int) -> DataFrame:
    """Rotated by 90 degrees clockwise."""
    return px.select("page_id", F.col("x").alias("y"), (height - 1 - F.col("y")).alias("x"), "v")


def row_profile(bits: DataFrame) -> DataFrame:
    return bits.groupBy("page_id", "y").agg(F.sum("ink").alias("ink"), F.count("*").alias("extent"))


def ink_box(bits: DataFrame) -> DataFrame:
    """Tight box, right and bottom exclusive, and the share of ink; no row for a page without ink."""
    ink = bits.filter("ink = 1").groupBy("page_id").agg(F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") + 1).alias("r"), (F.max("y") + 1).alias("b"), F.count("*").alias("ink"))
    return ink


def square_sum(bits: DataFrame) -> DataFrame:
    """Sum of squared differences of neighbouring rows' ink, by which a page's skew is judged."""
    order = Window.partitionBy("page_id").orderBy("y")
    steps = row_profile(bits).withColumn("d", F.col("ink") - F.lag("ink").over(order))
    return steps.groupBy("page_id").agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0)).alias("score"))


def runs(bits: DataFrame, least: int) -> DataFrame:
    """Runs of at least ``least`` inked rows: ``page_id top bottom`` (exclusive)."""
    inked = row_profile(bits).filter("ink > 0").withColumn("island", F.col("y") - F.row_number().over(Window.partitionBy("page_id").orderBy("y")))
    return inked.groupBy("page_id", "island").agg(F.min("y").alias("top"), (F.max("y") + 1).alias("bottom")).filter(F.col("bottom") - F.col("top") >= least).drop("island")


def statistics(px: DataFrame) -> DataFrame:
    """Mean, deviation, mode (highest of equals, but the lowest value wins a tie with it), medians and 0.9 quantile, all from the histogram."""
    up = Window.partitionBy("page_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy("page_id")
    hist = histogram(px).withColumn("below", F.sum("c").over(up)).withColumn("n", F.sum("c").over(page))
    hist = hist.withColumn("tie", F.when(F.col("v") == F.min("v").over(page), 256).otherwise(F.col("v")))
    at = lambda k: F.min(F.when(F.col("below") > k, F.col("v")))
    place = (F.col("n") - 1) * F.lit(0.9)
    total = F.sum(F.col("c") * F.col("v")) / F.sum("c")
    out = hist.groupBy("page_id").agg(
        F.max_by("v", F.struct("c", "tie")).alias("mode"), total.alias("exact"), (F.sum(F.col("c") * F.col("v") * F.col("v")) / F.sum("c")).alias("square"), at(F.expr("(n - 1) div 2")).alias("lower"),
        at(F.expr("n div 2")).alias("upper_median"), at(F.floor(place)).alias("p_low"), at(F.ceil(place)).alias("p_high"), F.max(place - F.floor(place)).alias("part"),
    )
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("exact") * F.col("exact")))
    return out.select(
        "page_id", "mode", F.round("exact", 4).alias("mean"), F.round(deviation, 4).alias("sd"), ((F.col("lower") + F.col("upper_median")) / 2).alias("median"),
        "upper_median", F.round(F.col("p_low") + (F.col("p_high") - F.col("p_low")) * F.col("part"), 4).alias("p90"),
    )
