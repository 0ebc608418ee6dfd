"""Pages at other sizes: weights of source pixels for target pixels as a relation of each axis, and box-mean sharpening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import halved

#: From which factor pixels are interpolated, up to which the result is sharpened, and above which a reduced page is.
INTERPOLATED, SHARPENED, REDUCED_SHARPENED, LEAST = 0.7, 1.4, 0.2, 0.02
#: Half width and strength of sharpening for interpolated and for reduced pages.
STRONG, WEAK = (2, 0.4), (1, 0.2)
#: Factors that are repeated halvings.
HALVINGS = {0.5: 1, 0.25: 2, 0.125: 3, 0.0625: 4}


def _float(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def target(side: str) -> Column:
    """A side's length after scaling by ``f``, in single precision."""
    return (_float(F.col("f")) * _float(F.col(side)) + _float(0.5)).cast("int")


def axis(pages: DataFrame, side: str, area: bool) -> DataFrame:
    """``side f target source weight first edge`` of each length and factor: what a source line weighs in a target line, in sixteenths.

    Interpolation takes two neighbours, at the far end one.  Area mapping
    takes every line that a target line covers; where it would reach the last
    line, the target is at the ``edge`` and takes its first source as it is.
    """
    own = pages.select(F.col(side).alias("side"), "f", target(side).alias("n")).distinct().filter("n > 0")
    own = own.withColumn("step", (_float(16.0) * _float(F.col("side")) / _float(F.col("n"))).cast("float")).withColumn("target", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    lo = (F.col("step") * _float(F.col("target"))).cast("float").cast("int")
    own = own.withColumn("lo", lo).withColumn("first", F.shiftright("lo", 4)).withColumn("part", F.col("lo").bitwiseAND(15))
    row = lambda source, weight: F.struct(source.cast("int").alias("source"), weight.cast("int").alias("weight"))
    if not area:
        two = F.array(row(F.col("first"), 16 - F.col("part")), row(F.least(F.col("first") + 1, F.col("side") - 1), F.col("part")))
        own = own.withColumn("edge", F.lit(False)).withColumn("w", F.explode(two))
    else:
        hi = (F.col("step").cast("double") * (F.col("target") + 1).cast("double")).cast("int")
        own = own.withColumn("hi", hi).withColumn("last", F.shiftright("hi", 4)).withColumn("edge", F.col("last") > F.col("side") - 2)
        weight = lambda k: F.when(k == F.col("first"), 16 - F.col("part")).when(k == F.col("last"), F.col("hi").bitwiseAND(15)).otherwise(16)
        lines = F.transform(F.sequence(F.col("first"), F.least(F.col("last"), F.col("side") - 1)), lambda k: row(k, weight(k)))
        own = own.withColumn("w", F.explode(lines))
    out = own.groupBy("side", "f", "target", F.col("w.source").alias("source")).agg(F.sum("w.weight").alias("weight"), F.first("first").alias("first"), F.first("edge").alias("edge"))
    return out.filter("weight > 0 or source = first")


def weighted(px: DataFrame, pages: DataFrame, area: bool) -> DataFrame:
    """Pixels ``page_id y x v`` of the scaled pages."""
    named = lambda df, side, at: df.select(F.col("side").alias(side), "f", F.col("source").alias(at), F.col("target").alias(f"to_{at}"), F.col("weight").alias(f"weight_{at}"), (F.col("source") == F.col("first")).alias(f"first_{at}"), F.col("edge").alias(f"edge_{at}"))
    # an axis has a few rows for each length, factor and line, whatever the number of pages
    down, across = F.broadcast(named(axis(pages, "h", area), "h", "y")), F.broadcast(named(axis(pages, "w", area), "w", "x"))
    own = px.join(pages, "page_id").join(down, ["h", "f", "y"]).join(across, ["w", "f", "x"])
    weight = F.col("weight_y") * F.col("weight_x")
    corner = F.max(F.when(F.col("first_y") & F.col("first_x"), F.col("v")))
    out = own.groupBy("page_id", F.col("to_y").alias("y"), F.col("to_x").alias("x")).agg(F.sum(weight * F.col("v")).alias("s"), F.sum(weight).alias("a"), corner.alias("corner"), F.max(F.col("edge_y") | F.col("edge_x")).alias("edge"))
    return out.select("page_id", "y", "x", F.when(F.col("edge"), F.col("corner")).otherwise(F.expr("(s + 128) div a")).cast("int").alias("v"))


def sharpened(px: DataFrame, half: int, strength: float) -> DataFrame:
    """Each pixel moved away from its box's mean; ``half`` pixels at the border stay."""
    across = Window.partitionBy("page_id", "y").orderBy("x")
    down = Window.partitionBy("page_id", "x").orderBy("y")
    own = px.withColumn("row", F.sum("v").over(across.rowsBetween(-half, half))).withColumn("n_x", F.count("*").over(across.rowsBetween(-half, half)))
    own = own.withColumn("box", F.sum("row").over(down.rowsBetween(-half, half))).withColumn("n_y", F.count("*").over(down.rowsBetween(-half, half)))
    side = 2 * half + 1
    mean = (_float(1.0 / (side * side)) * _float(F.col("box"))).cast("float")
    v = _float(F.col("v"))
    moved = (v + (_float(strength) * (v - mean).cast("float")).cast("float")).cast("float")
    value = F.least(F.lit(255), F.greatest(F.lit(0), (moved.cast("double") + 0.5).cast("int")))
    inner = (F.col("n_x") == side) & (F.col("n_y") == side)
    return own.select("page_id", "y", "x", F.when(inner, value).otherwise(F.col("v")).cast("int").alias("v"))


def scaled(px: DataFrame, pages: DataFrame) -> DataFrame:
    """Pixels of pages (page_id w h f) scaled by ``f`` each: interpolated, area-mapped or halved, and sharpened, as its factor asks for.

    Factors below ``LEAST`` are not scaled; their pages are left out.  Pages
    meet their pixels where these are dealt by page, and are not gathered on
    the driver, however small Spark takes them for; pixels need no sorting.
    """
    pages = pages.select("page_id", "w", "h", F.col("f").cast("float").alias("f"))
    f = F.col("f")
    halving = F.coalesce(*(F.when(f == _float(k), F.lit(n)) for k, n in HALVINGS.items()))
    way = F.when(f == 1, "same").when(f >= _float(SHARPENED), "interpolated").when(f >= _float(INTERPOLATED), "interpolated sharp").when(halving.isNotNull(), F.concat(F.lit("halved "), halving.cast("string")))
    way = way.when(f > _float(REDUCED_SHARPENED), "mapped sharp").when(f >= _float(LEAST), "mapped")
    own = pages.withColumn("way", way)
    of = lambda name: own.filter(F.col("way") == name).drop("way").hint("shuffle_hash")
    source = lambda name: px.join(of(name).select("page_id").hint("shuffle_hash"), "page_id", "left_semi")
    out = source("same").select("page_id", "y", "x", "v").unionByName(weighted(px, of("interpolated"), False)).unionByName(weighted(px, of("mapped"), True))
    out = out.unionByName(sharpened(weighted(px, of("interpolated sharp"), False), *STRONG)).unionByName(sharpened(weighted(px, of("mapped sharp"), True), *WEAK))
    for k, n in HALVINGS.items():
        part = source(f"halved {n}")
        for _ in range(n):
            part = halved(part)
        out = out.unionByName(sharpened(part, *WEAK) if k > REDUCED_SHARPENED else part)
    return out.select("page_id", *(F.col(c).cast("int").alias(c) for c in "yxv"))


def to_height(px: DataFrame, pages: DataFrame, height: int) -> DataFrame:
    """Pages (page_id w h) scaled to one height."""
    return scaled(px, pages.filter("h > 0 and w > 0").withColumn("f", _float(height) / _float(F.col("h"))))
