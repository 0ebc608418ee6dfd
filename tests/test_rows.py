"""Raster operators on page rows against pages made by hand."""

import pytest
from pyspark.sql import functions as F

from pageloom.operators import components, rows, shared
from pageloom.operators import page as paging


def page(spark, *lines, column="ink"):
    return spark.createDataFrame([(1, y, [int(c) for c in line.split()] if " " in line else [int(c) for c in line]) for y, line in enumerate(lines)], f"page_id long, y int, {column} array<int>")


def shown(df):
    return [r.bits for r in rows.drawn(df).orderBy("y").collect()]


def test_even_brick_reaches_left_and_up_of_its_origin(spark):
    assert shown(rows.dilated(page(spark, "00000", "00000", "00100", "00000", "00000"), 2, 1)) == ["00000", "00000", "01100", "00000", "00000"]
    assert shown(rows.dilated(page(spark, "000", "000", "010", "000"), 1, 2)) == ["000", "010", "010", "000"]


def test_erosion_clears_the_border(spark):
    full = page(spark, *["11111"] * 5)
    got = shown(rows.eroded(full, 2, 3))
    assert got == ["00000", "01111", "01111", "01111", "00000"]
    assert shown(rows.eroded(full, 1, 1)) == ["11111"] * 5


def test_closing(spark):
    dots = page(spark, "10100", "00000", "10100")
    assert shown(rows.closed(dots, 3, 1)) == ["01100", "00000", "01100"]
    assert shown(rows.closed_safely(dots, 3, 1)) == ["11100", "00000", "11100"]
    assert shown(rows.opened(page(spark, "01110", "01110", "00010"), 2, 2)) == ["01110", "01110", "00000"]


def test_sequences(spark):
    one = page(spark, "0000", "0110", "0000", "0001")
    assert shown(rows.sequenced(one, "r1")) == ["11", "01"]
    assert shown(rows.sequenced(one, "b2 + e1.1")) == shown(one)
    assert shown(rows.sequenced(one, "R1+x2")) == ["1111", "1111", "0011", "0011"]
    for wrong in ("", "d3", "q2.2", "d0.1", "r12345", "e1.1+", "b0"):
        assert rows.sequenced(one, wrong) is None


def test_windows_of_a_flat_page(spark):
    flat = page(spark, *[" ".join(["200"] * 9)] * 9, column="v")
    got = rows.local_thresholds(flat, 3, sauvola=0.5).first()
    assert set(got.m) == {200} and set(got.q) == {40000} and set(got.sauvola) == {100}


def test_mirrored_edges(spark):
    edge = page(spark, *[" ".join(map(str, [10, 20, 30, 40, 50, 60, 70]))] * 7, column="v")
    assert rows.window_statistics(edge, 1).filter("y = 0").first().m == [13, 20, 30, 40, 50, 60, 66]


@pytest.mark.parametrize("connectivity, boxes", [(8, [(0, 0, 5, 2, 5), (0, 2, 1, 3, 1)]), (4, [(0, 0, 2, 1, 2), (3, 0, 5, 1, 2), (2, 1, 3, 2, 1), (0, 2, 1, 3, 1)])])
def test_components(spark, connectivity, boxes):
    corners = page(spark, "11011", "00100", "10000")
    got = [(r.l, r.t, r.r, r.b, r.px) for r in components.components(components.labelled(components.ink_runs(corners), connectivity)).orderBy("comp").collect()]
    assert got == boxes


def test_ladder_keeps_lazy_order(spark):
    flat = page(spark, *[" ".join(["200"] * 7)] * 7, column="v")
    none = flat.select("page_id", "y", F.transform("v", lambda _: F.lit(0)).alias("ink"))
    assert {r["mode"] for r in rows.escalated(none, flat, 2).collect()} == {"singh"}


def test_tiny_pages(spark):
    """Pages too small for a step are left out, give nothing or go another way, beside a page of full size."""
    grey = [(1, y, [0 if 3 < x < 7 and y > 2 else 200 for x in range(12)]) for y in range(11)] + [(2, y, [10, 200, 90]) for y in range(3)] + [(3, 0, [7]), (4, 0, [5, 250]), (4, 1, [5, 250])]
    own = spark.createDataFrame(grey, "page_id long, y int, v array<int>")
    ink = own.select("page_id", "y", F.transform("v", lambda v: (v < 100).cast("int")).alias("ink"))
    assert {r.page_id for r in rows.local_thresholds(own, 4).collect()} == {1}
    assert rows.local_thresholds(own, 1).count() == 0  # a window's half size is two at least
    for mode in ("sauvola", "wolf", "singh"):
        got = {(r.page_id, r.y): r.ink for r in rows.binarized_with(mode, ink, own, 4).collect()}
        assert len(got) == len(grey) and got[2, 0] == [1, 0, 1] and got[3, 0] == [1] and got[4, 1] == [1, 0]
    assert {(r.page_id, r.y): r.ink for r in rows.binarized_with("otsu", ink, own, 4).collect()} == {(r.page_id, r.y): r.ink for r in ink.collect()}
    modes = {r.page_id: r["mode"] for r in rows.escalated(ink, own, 4).collect()}
    assert modes.keys() == {1, 2, 3, 4} and all(modes[p] == "singh" for p in (2, 3, 4))
    assert {r.page_id: r.ink for r in rows.rank_reduced(ink, 1).filter("y = 0").collect() if r.ink}.keys() == {1, 2, 4}
    assert rows.rank_reduced(ink.filter("page_id = 4"), 2).collect()[0].ink == [1]
    assert {r.page_id for r in paging.mirrored(own, 3).collect()} == {1, 2} and {r.page_id for r in paging.mirrored(own, 2).collect()} == {1, 2, 4}


def test_ladder_takes_every_rung(spark):
    """Pages of stripes on which each method in turn is the first with a plausible share of ink."""
    import numpy as np

    rng = np.random.default_rng(1)
    pages = {}
    pages[1] = np.full((40, 40), 230)
    pages[1][10:12, 5:35] = 20  # clean: Otsu
    for page in range(2, 40):
        shade = np.linspace(60 + 4 * (page % 7), 240, 40)[None, :] * np.linspace(1, 0.5 + (page % 5) / 10, 40)[:, None]
        pages[page] = shade.copy()
        pages[page][10:30:6, 5:35] -= 6 + 3 * (page % 9)
        pages[page] = np.clip(pages[page] + rng.normal(0, page % 3, (40, 40)), 0, 255).astype(int)
    own = spark.createDataFrame([(p, y, [int(v) for v in row]) for p, g in pages.items() for y, row in enumerate(g)], "page_id long, y int, v array<int>").repartition(4, "page_id")
    ink = spark.createDataFrame([(p, y, [int(v < (128 if p == 1 else int(np.median(g)))) for v in row]) for p, g in pages.items() for y, row in enumerate(g)], "page_id long, y int, ink array<int>")
    share = {m: {r.page_id: r.share for r in rows.ink_share(rows.binarized_with(m, ink, own, 4)).collect()} for m in ("otsu", "sauvola", "wolf", "singh")}
    got = {r.page_id: r["mode"] for r in rows.escalated(ink, own, 4).select("page_id", "mode").distinct().collect()}
    want = {p: next((m for m in ("otsu", "sauvola", "wolf") if 0.005 <= share[m][p] <= 0.15), "singh") for p in pages}
    assert got == want and len(set(got.values())) >= 3, (set(got.values()))


def test_labels_shuffle_by_page_once(spark, monkeypatch):
    """A round of labels deals links and labels by page, and no join deals either again; the setting comes back."""
    plans, kept = [], components.kept
    monkeypatch.setattr(components, "kept", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    runs = spark.createDataFrame([(p, 4 * y + x, y, 2 * x, 2 * x + 1) for p in range(3) for y in range(4) for x in range(4)], "page_id long, run int, y int, l int, r int")
    assert {r.label for r in components.labelled(runs, 4).collect()} == {0, 1, 2, 3}
    rounds = plans[2:]
    assert rounds and not any("ENSURE_REQUIREMENTS" in plan for plan in rounds)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before


@pytest.mark.parametrize("links", [1 << 20, 3, 1])
def test_labels_of_pages_in_parts(spark, monkeypatch, links):
    """Snakes through all rows, of one component each, beside single runs; whole pages in one task, or pages of more links than a task takes."""
    monkeypatch.setattr(components, "LINKS", links)
    rows = [(p, y, y, *((0, 9) if y % 2 == 0 else (8, 9) if y % 4 == 1 else (0, 1))) for p in (1, 2) for y in range(12)]
    rows += [(3, k, 2 * k, 0, 5) for k in range(6)]
    runs = spark.createDataFrame(rows, "page_id int, run int, y int, l int, r int")
    got = {(r.page_id, r.run): r.label for r in components.labelled(runs, 4).collect()}
    assert got == {(p, k): 0 if p < 3 else k for p, k, *_ in rows}


def test_whole_pages_are_labelled_without_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "kept", lambda df: written.append(df) or shared.kept(df))
    runs = spark.createDataFrame([(1, k, k, 0, 3) for k in range(64)], "page_id int, run int, y int, l int, r int")
    assert {r.label for r in components.labelled(runs, 4).collect()} == {0} and len(written) == 3
