"""Page layout: regions, table grids, column lattices, cuts along an axis, line pitch and paragraph gaps.

Boxes are ``l t r b`` with y down.  Rows with a null key or box join nothing
and are left out; a page without rows has no result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Height of the strips by which lines and blocks meet, so that a line is compared only with blocks near it.
STRIP = 256


def upper_median(value: str) -> Column:
    """The middle value, the greater of two."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def _union() -> list[Column]:
    return [F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b")]


def regions(lines: DataFrame, blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """``doc_id region_idx kind l t r b line_ids`` in the order header, blocks, other text, figures, footer.

    ``lines``: doc_id line_idx l t r b band; ``blocks``: doc_id block l t r b
    is_table, in reading order; ``figures``: doc_id figure l t r b.  A line of
    no band goes to the first block that holds its centre; blocks without
    lines are dropped, and lines without a block make up one text region.
    """
    strip = lambda y: F.floor(y / STRIP)
    near = blocks.filter("b > t").select("doc_id", "block", "is_table", *(F.col(c).alias(f"block_{c}") for c in "ltrb"), F.explode(F.sequence(strip(F.col("t")), strip(F.col("b") - 1))).alias("strip"))
    own = lines.withColumn("x", F.expr("(l + r) div 2")).withColumn("y", F.expr("(t + b) div 2")).withColumn("strip", strip(F.col("y")))
    inside = (own.doc_id == near.doc_id) & (own.strip == near.strip) & own.band.isNull() & (own.x >= near.block_l) & (own.x < near.block_r) & (own.y >= near.block_t) & (own.y < near.block_b)
    met = own.join(near, inside, "left").select(own.doc_id, "line_idx", "l", "t", "r", "b", "band", F.when(F.col("block").isNotNull(), F.struct("block", "is_table")).alias("block"))
    placed = met.groupBy("doc_id", "line_idx").agg(*_union(), F.first("band").alias("band"), F.min("block").alias("block"))
    kind = F.coalesce("band", F.when(F.col("block.is_table"), "table").otherwise("text"))
    part = F.when(F.col("band") == "header", 0).when(F.col("band") == "footer", 4).when(F.col("block").isNull(), 2).otherwise(1)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("line_idx")), lambda i: i.cast("string")), " ")
    text = placed.groupBy("doc_id", part.alias("part"), F.coalesce("block.block", F.lit(0)).alias("n"), kind.alias("kind")).agg(*_union(), ids.alias("line_ids"))
    drawn = figures.select("doc_id", F.lit(3).alias("part"), F.col("figure").alias("n"), F.lit("figure").alias("kind"), "l", "t", "r", "b", F.lit("").alias("line_ids"))
    order = Window.partitionBy("doc_id").orderBy("part", "n")
    return text.unionByName(drawn).select("doc_id", (F.row_number().over(order) - 1).alias("region_idx"), "kind", "l", "t", "r", "b", "line_ids")


def merged(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans ``s e`` of each key, those that overlap or touch as one."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = spans.filter("e > s").withColumn("new", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int"))
    return own.withColumn("span", F.sum("new").over(order)).groupBy(*keys, "span").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("span")


def valleys(inked: DataFrame, *keys: str) -> DataFrame:
    """``s e first last`` of each key, ``page_id`` unless others are given: gaps between its spans (s e), and the ends of its ink."""
    keys = keys or ("page_id",)
    page = Window.partitionBy(*keys)
    own = merged(inked, *keys).withColumn("first", F.min("s").over(page)).withColumn("last", F.max("e").over(page))
    gap = own.withColumn("next", F.lead("s").over(page.orderBy("s"))).filter("next is not null")
    return gap.select(*keys, F.col("e").alias("s"), F.col("next").alias("e"), "first", "last")


#: Least share of the widest gap in a family of gutters, and least share of the mean column that the widest takes.
GUTTER_SHARE, GUTTER_COLUMN = 0.6, 0.05


def axis_cuts(inked: DataFrame, extents: DataFrame, share: float = 0.015, least: int = 24, gutters: Column | bool = True, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``cut thickness`` of each key: where its area parts along an axis, and its thickest gap.

    ``inked``: keys s e; ``extents``: keys extent.  A gap counts if it
    takes ``share`` of the extent; if none does, gaps near the widest count
    where there are two at least.  On both sides of it ``least`` pixels must
    lie up to the next gap that counts.
    """
    page, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("s")
    single = lambda v: F.lit(v).cast("float")
    gutters = F.lit(gutters) if isinstance(gutters, bool) else gutters
    width, extent = F.col("e") - F.col("s"), F.col("extent").cast("float")
    own = valleys(inked, *keys).join(extents, list(keys)).withColumn("wide", width >= F.greatest(F.ceil(single(share) * extent), F.lit(1)))
    own = own.withColumn("any", F.max("wide").over(page)).withColumn("widest", F.max(width).over(page))
    own = own.withColumn("family", width.cast("float") >= single(GUTTER_SHARE) * F.col("widest").cast("float"))
    own = own.withColumn("n", F.count(F.when(F.col("family"), 1)).over(page))
    column = (extent / (F.col("n") + 1).cast("float")).cast("float")
    second = F.col("family") & (F.col("n") >= 2) & (F.col("widest").cast("float") >= single(GUTTER_COLUMN) * column) & gutters
    counted = own.filter(F.when(F.col("any"), F.col("wide")).otherwise(second))
    before, behind = F.coalesce(F.lag("e").over(order), "first"), F.coalesce(F.lead("s").over(order), "last")
    kept = counted.withColumn("before", F.col("s") - before).withColumn("behind", behind - F.col("e")).filter((F.col("before") >= least) & (F.col("behind") >= least))
    return kept.select(*keys, F.expr("(s + e) div 2").alias("cut"), F.max(width).over(page).alias("thickness"))


def table_cells(words: DataFrame) -> DataFrame:
    """``table_id row col header l t r b text conf``: the words (table_id row word_idx l t r b text conf) of each row by columns.

    Columns are parted where more than half of the rows are blank over at
    least twice the usual word height; two such gaps with a sliver between
    them, narrower than both and than a word is high, count as one.  A word
    belongs to the column of its centre.  Row 0 is the header.  Words dealt by
    table_id are not shuffled again: all else goes by tables.
    """
    table, row = Window.partitionBy("table_id"), Window.partitionBy("table_id", "row").orderBy("l", "r")
    at = table.orderBy("x")
    words = words.filter("table_id is not null")
    placed = words.withColumn("reach", F.max("r").over(row.rowsBetween(Window.unboundedPreceding, -1))).withColumn("first", (F.row_number().over(row) == 1) & F.col("row").isNotNull())
    shape = {"x0": F.min("l"), "x1": F.max("r"), "n_rows": F.sum(F.col("first").cast("int")), "high": upper_median("greatest(b - t, 1)")}
    placed = placed.withColumns({k: v.over(table) for k, v in shape.items()}).withColumn("s", F.greatest("l", "reach"))
    new = F.coalesce((F.col("r") > F.col("l")) & (F.col("r") > F.col("s")), F.lit(False))  # what a word covers beyond those before it in its row
    step = lambda x, d: F.struct(x.alias("x"), F.when(new, d).otherwise(0).alias("d"))
    steps = placed.select("table_id", "x1", "n_rows", "high", F.inline(F.array(step(F.when(new, F.col("s")).otherwise(F.col("l")), 1), step(F.col("r"), -1)))).filter("x is not null")
    own = steps.withColumn("rows", F.sum("d").over(at)).withColumn("end", F.lead("x").over(at)).filter("end > x").withColumn("blank", F.expr("n_rows - rows >= n_rows div 2 + 1"))
    own = own.withColumn("turn", F.coalesce(F.col("blank") != F.lag("blank").over(at), F.lit(True)).cast("int")).withColumn("run", F.sum("turn").over(at)).filter("blank")
    gaps = own.groupBy("table_id", "run").agg(F.min("x").alias("s"), F.max("end").alias("e"), F.first("x1").alias("x1"), F.first("high").alias("high")).filter("e < x1")

    order = table.orderBy("s")
    gaps = gaps.withColumn("next_s", F.lead("s").over(order)).withColumn("next_e", F.lead("e").over(order))
    gaps = gaps.withColumn("near", F.coalesce(F.expr("next_s - e < least(e - s, next_e - next_s) and next_s - e < high"), F.lit(False)))
    gaps = gaps.withColumn("chain", F.sum(F.coalesce((~F.lag("near").over(order)).cast("int"), F.lit(0))).over(order))
    gaps = gaps.withColumn("k", F.row_number().over(Window.partitionBy("table_id", "chain").orderBy("s"))).filter("k % 2 = 1")
    gaps = gaps.withColumn("e", F.when(F.col("near"), F.col("next_e")).otherwise(F.col("e"))).filter("e - s >= 2 * high")
    cuts = gaps.groupBy("table_id").agg(F.collect_list(F.expr("(s + e) div 2")).alias("cuts"))  # no more than a page's width holds
    put = words.join(cuts.hint("merge"), "table_id", "left")  # a cut lies within the table, so a centre beyond its edge is on the same side of all
    put = put.withColumn("col", F.coalesce(F.size(F.filter("cuts", lambda c: F.coalesce(c <= F.expr("(l + r) div 2"), F.lit(True)))), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ")
    return put.groupBy("table_id", "row", "col").agg(*_union(), text.alias("text"), F.min("conf").alias("conf")).withColumn("header", F.col("row") == 0)


def column_lattice(blocks: DataFrame) -> DataFrame:
    """``page_id x0 width pitch last high`` of pages whose blocks (page_id l t r b) stand in regular columns.

    Blocks near the middle width set the step between left edges; at least
    three columns, and half of those up to the last, must be taken.
    """
    middle = lambda c: F.floor(F.median(c))
    own = blocks.withColumn("w", F.col("r") - F.col("l"))
    usual = own.groupBy("page_id").agg(middle("w").alias("width"), F.count("*").alias("n")).filter("n >= 3 and width > 0")
    even = own.join(usual, "page_id").filter("100 * w between 75 * width and 125 * width")
    edges = even.groupBy("page_id", "l").agg(F.count("*").alias("n"), F.first("width").alias("width"))
    edges = edges.withColumn("step", F.col("l") - F.lag("l").over(Window.partitionBy("page_id").orderBy("l")))
    fit = edges.groupBy("page_id").agg(F.min("l").alias("x0"), middle("step").alias("pitch"), F.sum("n").alias("n"), F.first("width").alias("m")).filter("n >= 3 and pitch > 0 and 10 * pitch >= 9 * m")
    slots = even.join(fit.drop("n"), "page_id").withColumn("k", F.expr("(2 * (l - x0) + pitch) div (2 * pitch)")).filter("100 * abs(x0 + k * pitch - l) <= 15 * pitch")
    out = slots.groupBy("page_id").agg(F.first("x0").alias("x0"), F.first("width").alias("width"), F.first("pitch").alias("pitch"), F.max("k").alias("last"), F.count_distinct("k").alias("taken"), middle(F.col("b") - F.col("t")).alias("high"))
    return out.filter("taken >= 3 and last >= 2 and 2 * taken >= last + 1").drop("taken")


def split_on_lattice(blocks: DataFrame, lattice: DataFrame) -> DataFrame:
    """``page_id block part l t r b``: blocks over two columns or more, half a cell high at least, cut between the columns; others stay whole."""
    own = blocks.join(lattice, "page_id", "left")
    ks = lambda last: F.sequence(F.lit(0).cast("bigint"), last)
    left = lambda k: F.col("x0") + k * F.col("pitch")
    held = lambda k: 2 * (F.least("r", left(k) + F.col("width")) - F.greatest("l", left(k))) >= F.col("width")
    between = F.transform(ks(F.col("last") - 1), lambda k: F.floor((left(k) + F.col("width") + left(k + 1)) / 2))
    split = F.col("x0").isNotNull() & (F.size(F.filter(ks(F.col("last")), held)) >= 2) & (2 * (F.col("b") - F.col("t")) >= F.col("high"))
    ends = lambda c: F.array(F.col(c).cast("bigint"))
    edges = F.concat(ends("l"), F.when(split, F.filter(between, lambda x: (x > F.col("l")) & (x < F.col("r")))).otherwise(F.array().cast("array<bigint>")), ends("r"))
    parts = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(F.element_at(edges, i).alias("l"), F.element_at(edges, i + 1).alias("r")))
    return own.select("page_id", "block", "t", "b", F.posexplode(parts).alias("part", "p")).select("page_id", "block", "part", "p.l", "t", "p.r", "b")


#: Bounds of a region's scale, within which it counts as 1, and to which it is clipped; share of a measure by which justified lines may differ.
SAME, CLIP, RAGGED = (0.8, 1.25), (0.5, 3.0), 0.02


def region_pitch(lines: DataFrame) -> DataFrame:
    """``page_id region pitch page_pitch scale justified`` from lines (page_id region line_idx l r baseline).

    Pitch is the middle distance of a region's baselines, from three on;
    ``page_pitch`` that of the whole page, never across regions.  ``justified``
    leaves out a region's last line and is null for fewer than three lines.
    """
    keys = ["page_id", "region"]
    by = Window.partitionBy(*keys)
    own = lines.withColumn("step", F.col("baseline") - F.lag("baseline").over(by.orderBy("baseline"))).withColumn("last", F.max("line_idx").over(by))
    own = own.withColumn("step", F.when(F.col("step") > 0, F.col("step")))
    right = F.when(F.col("line_idx") < F.col("last"), F.col("r"))
    found = own.groupBy(*keys).agg(
        F.count("baseline").alias("n"), upper_median("step").alias("pitch"), F.count("*").alias("n_lines"), F.max(right).alias("right"), F.min(right).alias("short"), F.min("l").alias("left"),
    )
    page = own.groupBy("page_id").agg(F.count("step").alias("n_steps"), upper_median("step").alias("page_pitch"))
    out = found.join(page, "page_id").withColumn("page_pitch", F.when(F.col("n_steps") >= 3, F.col("page_pitch"))).withColumn("pitch", F.when(F.col("n") >= 3, F.col("pitch")))
    ratio = F.when(F.col("page_pitch") > 0, F.col("pitch") / F.col("page_pitch"))
    scale = F.when(ratio.isNull() | ratio.between(*SAME), 1.0).otherwise(F.least(F.lit(CLIP[1]), F.greatest(F.lit(CLIP[0]), ratio)))
    measure = F.col("right") - F.col("left")
    justified = F.when((F.col("n_lines") >= 3) & (measure > 0), (F.col("right") - F.col("short")) / measure <= RAGGED)
    return out.select(*keys, "pitch", "page_pitch", scale.alias("scale"), justified.alias("justified"))


def paragraph_starts(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """``page_id line_idx`` of lines with a paragraph's gap before them.

    ``lines``: page_id line_idx t b, in order down the page; ``runs``: blank
    rows page_id s e.  The longest run between two lines' centres is their
    gap; twice the middle gap starts a paragraph.  Pages of fewer than three
    lines, or with 0.3 of the gaps at 0, have none.
    """
    spots = lines.select("page_id", (F.col("t") + F.col("b")).alias("at"), F.lit(1).alias("line"), "line_idx", F.lit(0).alias("len"))
    blank = runs.select("page_id", (F.col("s") + F.col("e")).alias("at"), F.lit(0).alias("line"), F.lit(None).cast("int").alias("line_idx"), (F.col("e") - F.col("s")).alias("len"))
    order = Window.partitionBy("page_id").orderBy("at", "line", "line_idx")
    after = F.sum("line").over(order)
    first = F.min(F.when(F.col("line") == 1, F.col("at"))).over(Window.partitionBy("page_id"))
    k = F.when((after == 0) & (F.col("at") == first), 1).otherwise(after)
    held = spots.unionByName(blank).withColumn("k", k).groupBy("page_id", "k").agg(F.max("len").alias("gap"), F.max("line_idx").alias("line_idx"))
    page = Window.partitionBy("page_id")
    own = held.filter("k > 0").withColumn("next", F.lead("line_idx").over(page.orderBy("k"))).filter("next is not null")
    usual = own.groupBy("page_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("gap") == 0, 1)).alias("zero"), F.greatest(upper_median("gap"), F.lit(1)).alias("middle"))
    usual = usual.filter((F.col("n") >= 2) & (F.col("zero").cast("float") < F.lit(0.3).cast("float") * F.col("n").cast("float")))
    return own.join(usual, "page_id").filter("gap >= 2 * middle").select("page_id", F.col("next").alias("line_idx"))


#: Fixed value: least slope that is worth correcting.
LEAST_SLOPE = 0.0087


def shear_ramp(rows: DataFrame, height: int) -> DataFrame:
    """``page_id m0 m1 significant``: the slope of a page's rows (page_id y slope) as a line over y.

    Slopes are compared at nine decimals, for the sums behind them differ in their last bits.
    """
    own = rows.groupBy("page_id").agg(F.avg("slope").alias("mean"), F.regr_slope("slope", "y").alias("m1"), F.regr_intercept("slope", "y").alias("m0"))
    own = own.select("page_id", F.coalesce("m0", "mean").alias("m0"), F.coalesce("m1", F.lit(0.0)).alias("m1"))
    return own.withColumn("significant", (F.round(F.abs("m0"), 9) > LEAST_SLOPE) | (F.round(F.abs("m1") * height, 9) > LEAST_SLOPE))


def without_trend(sizes: DataFrame, gate: float = 0.5) -> DataFrame:
    """``doc_id line_idx size`` of samples (doc_id line_idx y size) less the page's linear trend, where that fits well enough."""
    trend = sizes.groupBy("doc_id").agg(F.regr_slope("size", "y").alias("slope"), F.regr_r2("size", "y").alias("fit"), F.avg("y").alias("mean"))
    less = F.when(F.col("fit") >= gate, F.col("slope") * (F.col("y") - F.col("mean"))).otherwise(F.lit(0.0))
    return sizes.join(trend, "doc_id").select("doc_id", "line_idx", (F.col("size") - less).alias("size"))
