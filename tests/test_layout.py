"""Layout operators on small pages worked out by hand."""

from pageloom.operators import layout


def listed(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def words(spark, rows):
    """Rows of words given by their left and right edges, 10 high."""
    data = [(1, i, k, l, 20 * i, r, 20 * i + 10, f"w{k}", 90 - k) for i, row in enumerate(rows) for k, (l, r) in enumerate(row)]
    return spark.createDataFrame(data, "table_id int, row int, word_idx int, l int, t int, r int, b int, text string, conf int")


def columns(spark, rows):
    return [(r, c, t) for r, c, t in listed(layout.table_cells(words(spark, rows)).select("row", "col", "text"), "row", "col")]


def test_columns_need_wide_gaps(spark):
    assert columns(spark, [[(0, 30), (50, 80)], [(0, 30), (50, 80)]]) == [(0, 0, "w0"), (0, 1, "w1"), (1, 0, "w0"), (1, 1, "w1")]
    assert columns(spark, [[(0, 30), (49, 80)], [(0, 30), (49, 80)]]) == [(0, 0, "w0 w1"), (1, 0, "w0 w1")]


def test_columns_need_most_rows(spark):
    assert columns(spark, [[(0, 30), (50, 80)], [(0, 80)]]) == [(0, 0, "w0 w1"), (1, 0, "w0")]
    assert [c[1] for c in columns(spark, [[(0, 30), (50, 80)], [(0, 30), (50, 80)], [(0, 78)]])] == [0, 1, 0, 1, 0]


def test_a_sliver_is_bridged_once(spark):
    # gaps of 12, 12 and 12 with slivers of 5: the first two make 29, the third stays alone and is too narrow
    assert columns(spark, [[(0, 30), (42, 47), (59, 64), (76, 110)]]) == [(0, 0, "w0"), (0, 1, "w1 w2 w3")]
    assert columns(spark, [[(0, 30), (42, 52), (64, 90)]]) == [(0, 0, "w0 w1 w2")]  # as wide as a word is high


def test_empty_table(spark):
    assert layout.table_cells(words(spark, [])).count() == 0


def test_regions(spark):
    box = "l int, t int, r int, b int"
    lines = spark.createDataFrame([(1, 0, 0, 0, 90, 10, "header"), (1, 1, 0, 20, 80, 30, None), (1, 2, 100, 20, 180, 30, None), (1, 3, 0, 40, 80, 50, None), (1, 4, 0, 900, 90, 910, "footer"), (1, 5, 0, 600, 10, 610, None)], f"doc_id int, line_idx int, {box}, band string")
    blocks = spark.createDataFrame([(1, 0, 0, 15, 95, 400, False), (1, 1, 0, 15, 200, 400, True), (1, 2, 0, 700, 9, 800, False), (1, 3, 40, 35, 41, 700, True)], f"doc_id int, block int, {box}, is_table boolean")
    figures = spark.createDataFrame([(1, 0, 5, 6, 7, 8), (2, 0, 1, 2, 3, 4)], f"doc_id int, figure int, {box}")
    got = listed(layout.regions(lines, blocks, figures).select("doc_id", "region_idx", "kind", "t", "b", "line_ids"), "doc_id", "region_idx")
    assert got == [
        (1, 0, "header", 0, 10, "0"), (1, 1, "text", 20, 50, "1 3"), (1, 2, "table", 20, 30, "2"), (1, 3, "text", 600, 610, "5"),
        (1, 4, "figure", 6, 8, ""), (1, 5, "footer", 900, 910, "4"), (2, 0, "figure", 2, 4, ""),
    ]


def cuts(spark, spans, extent, **more):
    inked = spark.createDataFrame([(1, s, e) for s, e in spans], "page_id int, s int, e int")
    return listed(layout.axis_cuts(inked, spark.createDataFrame([(1, extent)], "page_id int, extent int"), **more).select("cut", "thickness"), "cut")


def test_axis_cuts(spark):
    assert cuts(spark, [(0, 100), (115, 300), (330, 331), (340, 500)], 1000) == [(107, 30), (315, 30)]
    assert cuts(spark, [(0, 100), (114, 300)], 1000) == []  # 14 of 15 pixels
    assert cuts(spark, [(0, 23), (40, 300)], 1000) == []  # too little ink on one side
    assert cuts(spark, [(0, 300), (314, 600), (614, 900)], 1000, gutters=False) == []
    assert cuts(spark, [(0, 300), (314, 600), (614, 900)], 1000) == []  # 14 is under 0.05 of a third of 1000
    assert cuts(spark, [(0, 60), (74, 130), (144, 200), (214, 260)], 1000) == [(67, 14), (137, 14), (207, 14)]


def test_lattice(spark):
    data = [(0, 100), (120, 220), (240, 460), (480, 580), (600, 700)]
    blocks = spark.createDataFrame([(1, i, l, 0, r, 50) for i, (l, r) in enumerate(data)], "page_id bigint, block bigint, l bigint, t bigint, r bigint, b bigint")
    lattice = layout.column_lattice(blocks)
    assert [tuple(r) for r in lattice.select("x0", "width", "pitch", "last", "high").collect()] == [(0, 100, 120, 5, 50)]
    got = listed(layout.split_on_lattice(blocks, lattice).select("block", "part", "l", "r"), "block", "part")
    assert got == [(0, 0, 0, 100), (1, 0, 120, 220), (2, 0, 240, 350), (2, 1, 350, 460), (3, 0, 480, 580), (4, 0, 600, 700)]
    assert layout.column_lattice(blocks.filter("block < 2")).count() == 0
    assert layout.split_on_lattice(blocks, layout.column_lattice(blocks.filter("block < 2"))).count() == 5


def test_paragraphs(spark):
    tops = [0, 24, 48, 102, 126]
    lines = spark.createDataFrame([(1, i, t, t + 20) for i, t in enumerate(tops)], "page_id int, line_idx int, t int, b int")
    blank = layout.valleys(lines.selectExpr("page_id", "t as s", "b as e"))
    assert listed(layout.paragraph_starts(lines, blank), "line_idx") == [(1, 3)]
    assert listed(layout.paragraph_starts(lines.filter("line_idx < 2"), blank), "line_idx") == []


def test_ramp_at_the_least_slope(spark):
    slopes = [(7, 0.007), (7, 0.003), (3, 0.011), (2, 0.014), (1, 0.001)]
    rows = spark.createDataFrame([(1, 100 * n, s) for n, s in slopes], "page_id int, y int, slope double").coalesce(1)
    same = [r.significant for turn in range(5) for r in layout.shear_ramp(rows.orderBy((rows.y + 100 * turn) % 700, "slope").coalesce(1), 800).collect()]
    got = layout.shear_ramp(rows, 800).first()
    assert same == [False] * 5 and not got.significant and round(got.m0, 12) == 0.0087  # as the sum has it, a little more or less
