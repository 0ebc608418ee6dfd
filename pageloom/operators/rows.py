"""Raster operators on page rows: ``page_id y`` and an array of the row's pixels.

All windows of a chain are over one page in the order of its rows, so that a
whole sequence takes one shuffle by ``page_id``; what happens within a row is
an array expression.  Rows of a page are 0, 1, 2 and so on, all of one length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _page():
    return Window.partitionBy("page_id").orderBy("y")


def either(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def both(a: Column, b: Column) -> Column:
    return F.least(a, b)


def exploded(rows: DataFrame, column: str = "v") -> DataFrame:
    """``page_id y x`` and the value."""
    return rows.select("page_id", "y", F.posexplode(column).alias("x", column))


def drawn(rows: DataFrame, column: str = "ink") -> DataFrame:
    """The row's pixels as a string."""
    return rows.select("page_id", "y", F.array_join(F.transform(column, lambda v: v.cast("string")), "").alias("bits"))


def _stacked(column: str, above: int, below: int, join) -> Column:
    """Pixel by pixel ``join`` of the rows from ``above`` rows before to ``below`` rows behind."""
    near = F.collect_list(column).over(_page().rowsBetween(-above, below))
    return F.aggregate(F.slice(near, 2, 1 << 30), F.element_at(near, 1), lambda a, r: F.zip_with(a, r, join))


def dilated(rows: DataFrame, w: int, h: int) -> DataFrame:
    """Ink where a w x h brick, its origin at half its size, put on an ink pixel reaches; outside is paper."""
    left, up = w - 1 - w // 2, h - 1 - h // 2
    across = F.transform("ink", lambda _, x: F.array_max(F.slice("ink", F.greatest(F.lit(1), x + 1 - left), F.least(x, F.lit(left)) + 1 + w // 2)))
    return rows.withColumn("ink", across).withColumn("ink", _stacked("ink", up, h // 2, either))


def eroded(rows: DataFrame, w: int, h: int) -> DataFrame:
    """Ink where all of the brick is ink; outside is paper, so ink at the border goes."""
    right, down = w - 1 - w // 2, h - 1 - h // 2
    whole = lambda _, x: F.when((x >= w // 2) & (x + right < F.size("ink")), F.array_min(F.slice("ink", F.greatest(F.lit(1), x + 1 - w // 2), w))).otherwise(0)
    out = rows.withColumn("ink", F.transform("ink", whole))
    full = F.count("*").over(_page().rowsBetween(-(h // 2), down)) == h
    return out.withColumn("ink", F.when(full, _stacked("ink", h // 2, down, both)).otherwise(F.transform("ink", lambda _: F.lit(0))))


def opened(rows: DataFrame, w: int, h: int) -> DataFrame:
    return dilated(eroded(rows, w, h), w, h)


def closed(rows: DataFrame, w: int, h: int) -> DataFrame:
    return eroded(dilated(rows, w, h), w, h)


def bordered(rows: DataFrame, n: int) -> DataFrame:
    """``n`` pixels of paper around the page."""
    blank = lambda v: F.transform(v, lambda _: F.lit(0))
    side = F.array_repeat(F.lit(0), n)
    wide = rows.withColumn("ink", F.concat(side, "ink", side))
    last = F.max("y").over(Window.partitionBy("page_id"))
    own = F.array(F.struct((F.col("y") + n).alias("y"), F.col("ink")))
    extra = lambda start: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((k + start).cast("int").alias("y"), blank(F.col("ink")).alias("ink")))
    none = F.filter(own, lambda _: F.lit(False))
    parts = F.concat(F.when(F.col("y") == 0, extra(F.lit(0))).otherwise(none), own, F.when(F.col("y") == F.col("last"), extra(F.col("y") + n + 1)).otherwise(none))
    return wide.withColumn("last", last).select("page_id", F.explode(parts).alias("p")).select("page_id", "p.y", "p.ink")


def inner(rows: DataFrame, n: int) -> DataFrame:
    """Without ``n`` pixels on each side."""
    last = F.max("y").over(Window.partitionBy("page_id"))
    own = rows.withColumn("last", last).filter((F.col("y") >= n) & (F.col("y") <= F.col("last") - n))
    return own.select("page_id", (F.col("y") - n).alias("y"), F.slice("ink", n + 1, F.size("ink") - 2 * n).alias("ink"))


def closed_safely(rows: DataFrame, w: int, h: int) -> DataFrame:
    """Closing as if paper went on beyond the page."""
    return rows if w == h == 1 else inner(closed(bordered(rows, max(w, h)), w, h), max(w, h))


def rank_reduced(rows: DataFrame, level: int) -> DataFrame:
    """Ink where at least ``level`` pixels of a 2 x 2 box are ink; an odd edge is dropped."""
    below = F.lead("ink").over(_page())
    places = F.slice(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size("ink") / 2).cast("int"))), F.lit(1), F.floor(F.size("ink") / 2).cast("int"))  # none on a page one pixel wide
    boxes = F.transform(places, lambda i: sum((F.element_at(c, i * 2 - k) for c in ("ink", "below") for k in (0, 1)), F.lit(0)))
    pairs = rows.withColumn("below", below).filter("y % 2 = 0 and below is not null")
    return pairs.select("page_id", F.expr("y div 2").cast("int").alias("y"), F.transform(boxes, lambda n: (n >= level).cast("int")).alias("ink"))


def rank_cascade(rows: DataFrame, levels: list[int]) -> DataFrame:
    """Up to four reductions; a level of 0 ends them."""
    for level in levels:
        if level == 0:
            break
        rows = rank_reduced(rows, level)
    return rows


def replicated(rows: DataFrame, across: int, down: int) -> DataFrame:
    """Each pixel ``across`` times and each row ``down`` times."""
    wide = F.flatten(F.transform("ink", lambda v: F.array_repeat(v, across)))
    return rows.select("page_id", F.explode(F.sequence((F.col("y") * down).cast("int"), (F.col("y") * down + down - 1).cast("int"))).alias("y"), wide.alias("ink"))


def subtracted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ink of ``a`` that ``b`` lacks."""
    return _joined(a, b, lambda x, y: x * (1 - y))


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    return _joined(a, b, either)


def _joined(a, b, join):
    other = b.select("page_id", "y", F.col("ink").alias("other"))
    return a.join(other, ["page_id", "y"]).select("page_id", "y", F.zip_with("ink", "other", join).alias("ink"))


def inverted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ink", F.transform("ink", lambda v: 1 - v))


def parsed(sequence: str) -> list[tuple[str, list[int]]] | None:
    """Steps of a sequence such as ``b4 + d3.2 + o2.2 + r12 + x2``, or None if any is wrong."""
    out = []
    for part in re.sub("[ \n\t]", "", sequence).split("+"):
        brick = re.fullmatch(r"([deoc])(\d+)\.(\d+)", part, re.IGNORECASE)
        rank = re.fullmatch(r"r([0-4]{1,4})", part, re.IGNORECASE)
        other = re.fullmatch(r"([xb])(\d+)", part, re.IGNORECASE)
        numbers = [int(n) for n in brick.groups()[1:]] if brick else [int(n) for n in rank[1]] if rank else [int(other[2])] if other else [0]
        if not rank and min(numbers) < 1:
            return None
        out.append((part[0].lower(), numbers))
    return out


def sequenced(rows: DataFrame, sequence: str) -> DataFrame | None:
    """The steps one after another; closing is the safe one, a border goes at the end; None for a wrong sequence."""
    steps, border = parsed(sequence), 0
    if steps is None:
        return None
    for kind, n in steps:
        if kind == "r":
            rows = rank_cascade(rows, n)
        elif kind == "x":
            rows = replicated(rows, n[0], n[0])
        elif kind == "b":
            border = n[0]
            rows = bordered(rows, border)
        else:
            rows = {"d": dilated, "e": eroded, "o": opened, "c": closed_safely}[kind](rows, *n)
    return inner(rows, border) if border else rows


def window_statistics(rows: DataFrame, k: int) -> DataFrame:
    """``m`` and ``q`` besides ``v``: mean (cut to whole numbers) and mean square (rounded) of the (2k+1)-square around each pixel.

    Pixels beyond the page are those on it, mirrored at its edge.
    """
    side = 2 * k + 1
    padded = F.concat(F.reverse(F.slice("v", 1, k)), "v", F.reverse(F.slice("v", F.size("v") - k + 1, k)))
    spread = rows.withColumn("wide", padded)
    total = lambda f: F.transform(F.sequence(F.lit(1), F.size("v")), lambda x: F.aggregate(F.slice("wide", x, side), F.lit(0), lambda a, p: a + f(p)))
    spread = spread.select("page_id", "y", "v", total(lambda p: p).alias("s"), total(lambda p: p * p).alias("q"))
    near = F.collect_list(F.struct("y", "s", "q")).over(_page().rowsBetween(-k, k))
    last = F.max("y").over(Window.partitionBy("page_id"))

    def summed(name):
        inside = F.col("near")
        mirrored = F.transform(F.sequence(F.col("y") - k, F.col("y") + k), lambda y: F.when(y < 0, -y - 1).when(y > F.col("last"), 2 * F.col("last") + 1 - y).otherwise(y))
        picked = F.transform(mirrored, lambda y: F.element_at(inside, (y - F.element_at(inside, 1)["y"] + 1).cast("int"))[name])
        return F.aggregate(F.slice(picked, 2, side), F.element_at(picked, 1), lambda a, r: F.zip_with(a, r, lambda x, z: x + z))

    own = spread.withColumn("near", near).withColumn("last", last).select("page_id", "y", "v", summed("s").alias("s"), summed("q").alias("q"))
    one = F.lit(1.0).cast("float") / F.lit(float(side * side)).cast("float")
    mean = F.transform("s", lambda s: (one.cast("float") * s.cast("float")).cast("float").cast("int"))
    square = F.transform("q", lambda q: F.floor(q * F.lit(1.0 / (side * side)) + 0.5).cast("int"))
    return own.select("page_id", "y", "v", mean.alias("m"), square.alias("q"))


def fits(k: int) -> Column:
    """Whether a page is large enough for windows of half size ``k``, over its rows ``v``."""
    page = Window.partitionBy("page_id")
    return F.lit(k >= 2) & (F.min(F.size("v")).over(page) >= 2 * k + 3) & (F.count("*").over(page) >= 2 * k + 3)


def local_thresholds(rows: DataFrame, k: int, sauvola: float = 0.34, wolf: float = 0.5, singh: float = 0.06) -> DataFrame:
    """Rows ``v`` with the thresholds that three local methods set at each pixel; pages too small for the window are left out."""
    single = lambda x: F.lit(x).cast("float")
    own = window_statistics(rows.withColumn("fits", fits(k)).filter("fits").drop("fits"), k)
    deviation = F.zip_with("m", "q", lambda m, q: F.when(q >= m * m, F.sqrt((q - m * m).cast("float")).cast("float")))
    own = own.withColumn("sd", deviation)
    page = Window.partitionBy("page_id")
    own = own.withColumn("most", F.max(F.array_max("sd")).over(page)).withColumn("least", F.min(F.array_min("v")).over(page).cast("float"))
    low_byte = lambda t: F.coalesce(F.pmod(t.cast("int"), F.lit(256)), F.lit(0))
    by_sauvola = F.zip_with("m", "sd", lambda m, sd: low_byte(m * (1.0 - single(sauvola).cast("double") * (1.0 - sd.cast("double") / 128.0))))

    def clamped(t):
        return F.coalesce(F.least(F.lit(255.0), F.greatest(F.lit(0.0), t.cast("double"))).cast("int"), F.lit(0))

    def wolf_of(m, sd):
        part = F.when(F.col("most") > 0, (sd / F.col("most")).cast("float")).otherwise(single(0))
        lift = (single(wolf) * (part - single(1)).cast("float")).cast("float") * (m.cast("float") - F.col("least")).cast("float")
        return clamped((m.cast("float") + lift.cast("float")).cast("float"))

    def singh_of(v, m):
        v, m = ((c.cast("float") / single(255)).cast("float") for c in (v, m))
        base = (single(1) - v + m).cast("float")
        ratio = F.when(base > single(2.0**-23), ((m * (v - m)).cast("float") / base).cast("float")).otherwise(single(1))
        return clamped(((m + (single(singh) * (ratio - m)).cast("float")).cast("float") * single(255)).cast("float"))

    return own.select("page_id", "y", "v", "m", "q", by_sauvola.alias("sauvola"), F.zip_with("m", "sd", wolf_of).alias("wolf"), F.zip_with("v", "m", singh_of).alias("singh"))


def inked(rows: DataFrame, threshold: str) -> DataFrame:
    """Ink below the local threshold."""
    return rows.select("page_id", "y", F.zip_with("v", threshold, lambda v, t: (v < t).cast("int")).alias("ink"))


#: The least and greatest share of ink that a page of text has.
PLAUSIBLE = (0.005, 0.15)


def plausible(share: Column) -> Column:
    return share.between(*PLAUSIBLE)


def ink_share(rows: DataFrame) -> DataFrame:
    """``page_id share``: inked pixels among all."""
    return rows.groupBy("page_id").agg((F.sum(F.aggregate("ink", F.lit(0), lambda a, v: a + v)) / F.sum(F.size("ink"))).alias("share"))


def binarized_with(mode: str, otsu: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``page_id y ink`` by one method; pages too small for a local window go by Otsu's."""
    if mode == "otsu":
        return otsu.select("page_id", "y", "ink")
    local = inked(local_thresholds(rows, k), mode)
    small = rows.select("page_id", fits(k).alias("fits")).filter("not fits").select("page_id").distinct()
    return local.unionByName(otsu.join(small, "page_id", "left_semi").select("page_id", "y", "ink"))


def escalated(otsu: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``page_id mode y ink`` of the first method with a plausible share of ink: Otsu, Sauvola, Wolf, and else Singh.

    Local thresholds are computed for the pages alone that Otsu's method fails;
    on pages too small for them every method is Otsu's, and the last is kept.
    """
    return laddered(rows.join(otsu, ["page_id", "y"], "full"), k)


def laddered(rows: DataFrame, k: int) -> DataFrame:
    """The same for rows that hold ``v`` and, by Otsu's method, ``ink``; rows dealt by page are not shuffled."""
    whole = Window.partitionBy("page_id")
    share = F.sum(F.aggregate("ink", F.lit(0), lambda a, v: a + v)).over(whole) / F.sum(F.when(F.col("ink").isNotNull(), F.size("ink"))).over(whole)
    own = rows.filter("page_id is not null").withColumn("good", F.coalesce(plausible(share), F.lit(False))).withColumn("fits", fits(k))
    done = own.filter("ink is not null and (good or not fits)").select("page_id", F.when(F.col("good"), "otsu").otherwise("singh").alias("mode"), "y", "ink")
    local = local_thresholds(own.filter("not good and fits and v is not null").select("page_id", "y", "v"), k)
    for mode in ("sauvola", "wolf", "singh"):
        local = local.withColumn(mode, F.zip_with("v", mode, lambda v, t: (v < t).cast("int")))
    page, size = Window.partitionBy("page_id"), F.size("v")
    ink = {m: F.sum(F.aggregate(m, F.lit(0), lambda a, v: a + v)).over(page) / F.sum(size).over(page) for m in ("sauvola", "wolf")}
    mode = F.when(plausible(ink["sauvola"]), "sauvola").when(plausible(ink["wolf"]), "wolf").otherwise("singh")
    local = local.withColumn("mode", mode)
    picked = F.when(F.col("mode") == "sauvola", F.col("sauvola")).when(F.col("mode") == "wolf", F.col("wolf")).otherwise(F.col("singh"))
    return done.unionByName(local.select("page_id", "mode", "y", picked.alias("ink")))
