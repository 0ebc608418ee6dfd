"""Rows beside large initials, by hand."""

from pageloom.operators import seams

ROWS, SPANS, CAPS = "page_id long, row int, left int, bottom int, top int, reach float", "page_id long, row int, l int, r int", "page_id long, cap int, l int, b int, r int, t int"


def test_reaches(spark):
    spans = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 20, 30), (1, 0, 12, 18), (1, 1, 5, 9), (2, 0, 0, 4), (2, 0, 0, 4)], SPANS)
    assert sorted((r.page_id, r.row, r.reach) for r in seams.reaches(spans).collect()) == [(1, 0, 5.0), (2, 0, 0.0)]


def test_extended_left(spark):
    spans = spark.createDataFrame([(p, r, 40 + 12 * k, 48 + 12 * k) for p in (1, 2) for r in range(6) for k in range(1 if r == 5 else 3)], SPANS)
    rows = [(1, 0, 40, 100, 120, 6.0), (1, 1, 40, 60, 80, 6.0), (1, 2, 40, 0, 20, 6.0), (1, 3, 60, 100, 120, 6.0), (1, 4, 40, 100, 120, 50.0), (1, 5, 40, 100, 120, 6.0), (2, 0, 40, 100, 120, 6.0), (2, 1, 40, 20, 20, 6.0)]
    caps = [(1, 0, 10, 50, 38, 125), (1, 1, 36, 105, 41, 130), (1, 2, 12, 50, 38, 125), (2, 0, 10, 111, 38, 125)]
    got = seams.extended_left(spark.createDataFrame(rows, ROWS), spans, spark.createDataFrame(caps, CAPS))
    # row 2 is lower than any initial, 3 too far right, 5 has one glyph; page 2's initial covers less than half
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, 32), (1, 1, 0, 32), (1, 4, 0, 30)]


def test_initials_by_page(spark):
    letters = [(p, k, 20 * k, 0, 20 * k + 12, 14 + k % 3, 90) for p in (1, 2) for k in range(20)]
    boxes = letters + [(1, 90, 0, 30, 40, 78, 800), (2, 91, 0, 30, 300, 78, 8000), (3, 0, 0, 0, 10, 12, 40)]
    got = seams.initials_by_page(spark.createDataFrame(boxes, "page_id long, comp long, l int, t int, r int, b int, px long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 0), (3, 0)]
