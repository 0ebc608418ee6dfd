"""Recursive cuts: hand-made pages and random ones against a plain recursion over pixels."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import test_runs as grids_  # noqa: E402

from pageloom.operators import components, ruled, xycut  # noqa: E402


def axis(inked, share, least, gutters):
    """Plain version of one axis: (thickness, cuts) or None."""
    on = np.flatnonzero(inked)
    if not len(on):
        return None
    first, last, n = int(on[0]), int(on[-1]), len(inked)
    gaps = [(int(a) + 1, int(b)) for a, b in zip(on, on[1:]) if b > a + 1]
    least_gap = max(1, int(np.ceil(np.float32(share) * np.float32(n))))
    counted = [g for g in gaps if g[1] - g[0] >= least_gap]
    if not counted and gutters and gaps:
        widest = max(b - a for a, b in gaps)
        family = [g for g in gaps if np.float32(g[1] - g[0]) >= np.float32(0.6) * np.float32(widest)]
        if len(family) >= 2 and np.float32(widest) >= np.float32(0.05) * (np.float32(n) / np.float32(len(family) + 1)):
            counted = family
    ends = [first] + [b for _, b in counted], [a for a, _ in counted] + [last + 1]
    good = [g for k, g in enumerate(counted) if g[0] - ends[0][k] >= least and ends[1][k + 1] - g[1] >= least]
    return (max(b - a for a, b in good), [(a + b) // 2 for a, b in good]) if good else None


def plain(grid, depth, share, least, ink_share=0.0, box=None, whole=None):
    """Leaves of a 0/1 grid in reading order; ``whole(box)`` says what is not cut."""
    l, t, r, b = box or (0, 0, grid.shape[1], grid.shape[0])
    part = grid[t:b, l:r]

    def leaf():
        ys, xs = np.nonzero(part)
        return [(l + int(xs.min()), t + int(ys.min()), l + int(xs.max()) + 1, t + int(ys.max()) + 1)] if len(xs) else []

    if depth == 0 or r - l < least or b - t < least or whole is not None and whole((l, t, r, b)):
        return leaf()
    share_of = lambda n, k: np.float32(n) / np.float32(k) > np.float32(ink_share)
    v = axis([share_of(n, b - t) for n in part.sum(0)], share, least, True)
    h = axis([share_of(n, r - l) for n in part.sum(1)], share, least, False)
    if v is None and h is None:
        return leaf()
    if h is None or v is not None and v[0] >= h[0]:
        edges = [l, *(l + c for c in v[1]), r]
        return [x for a, c in zip(edges, edges[1:]) for x in plain(grid, depth - 1, share, least, ink_share, (a, t, c, b), whole)]
    edges = [t, *(t + c for c in h[1]), b]
    return [x for a, c in zip(edges, edges[1:]) for x in plain(grid, depth - 1, share, least, ink_share, (l, a, r, c), whole)]


def ink_of(spark, grids):
    runs = []
    for page, grid in grids.items():
        for y, row in enumerate(grid):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], row, [0]])))
            runs += [(page, int(a), y, int(c), y + 1) for a, c in zip(edge[::2], edge[1::2])]
    ink = spark.createDataFrame(runs, "page_id long, l int, t int, r int, b int")
    return ink, spark.createDataFrame([(p, g.shape[1], g.shape[0]) for p, g in grids.items()], "page_id long, w int, h int")


def leaves(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.page_id, r.leaf)):
        assert r.leaf == len(out.setdefault(r.page_id, []))
        out[r.page_id].append((r.l, r.t, r.r, r.b))
    return out


def blank(w, h, *boxes):
    grid = np.zeros((h, w), int)
    for l, t, r, b in boxes:
        grid[t:b, l:r] = 1
    return grid


def test_pages_by_hand(spark):
    grids = {
        1: blank(40, 30, (5, 5, 30, 20)),  # one block: its tight box
        2: blank(40, 30),  # no ink, no leaf
        3: blank(60, 30, (2, 2, 26, 28), (32, 2, 58, 28)),  # two columns
        4: blank(60, 60, (2, 2, 26, 26), (34, 2, 58, 26), (2, 34, 26, 58), (34, 34, 58, 58)),  # equal gaps: vertical first, so column by column
        5: blank(60, 60, (2, 2, 26, 26), (34, 2, 58, 26), (2, 36, 26, 58), (34, 36, 58, 58)),  # thicker gap between rows: row by row
        6: blank(200, 20, (0, 0, 66, 20), (67, 0, 132, 20), (133, 0, 200, 20)),  # thin gutters below the share, but too thin for the column
        7: blank(60, 20, (0, 0, 4, 20), (10, 0, 60, 20)),  # a sliver is not cut off
        8: blank(8, 30, (0, 0, 8, 10), (0, 20, 8, 30)),  # too narrow to be cut
    }
    ink, pages = ink_of(spark, grids)
    got = leaves(xycut.xy_cut(ink, pages, least=10))
    assert got == {
        1: [(5, 5, 30, 20)], 3: [(2, 2, 26, 28), (32, 2, 58, 28)], 4: [(2, 2, 26, 26), (2, 34, 26, 58), (34, 2, 58, 26), (34, 34, 58, 58)],
        5: [(2, 2, 26, 26), (34, 2, 58, 26), (2, 36, 26, 58), (34, 36, 58, 58)], 6: [(0, 0, 200, 20)], 7: [(0, 0, 60, 20)], 8: [(0, 0, 8, 30)],
    }
    whole = lambda rects: rects.filter("page_id = 4 and path <> '' and left = 0")  # noqa: E731  the first column is, say, a table
    assert leaves(xycut.xy_cut(ink, pages, least=10, whole=whole))[4] == [(2, 2, 26, 58), (34, 2, 58, 26), (34, 34, 58, 58)]


def nested(rng, depth, w, h, upright):
    """A page cut ``depth`` times, with gaps that get thinner level by level."""
    grid = np.ones((h, w), int)
    if depth == 0:
        return grid
    gap, side = 1 + depth, w if upright else h
    at = side // 2 + rng.randrange(-1, 2)
    half = [at - gap // 2, side - at - (gap - gap // 2)]
    parts = [nested(rng, depth - 1, n if upright else w, h if upright else n, not upright) for n in half]
    space = np.zeros((h, gap) if upright else (gap, w), int)
    return np.concatenate([parts[0], space, parts[1]], axis=1 if upright else 0)


@pytest.mark.parametrize("ink_share", [0.0, 0.05])
def test_against_recursion(spark, ink_share):
    rng = random.Random(11)
    grids = {0: nested(rng, 6, 150, 150, True), 1: nested(rng, 7, 260, 260, False)}
    for page in range(2, 14):
        boxes = [(x, y, x + rng.randint(3, 25), y + rng.randint(2, 20)) for x, y in ((rng.randrange(0, 90), rng.randrange(0, 70)) for _ in range(rng.randint(1, 9)))]
        grids[page] = blank(110, 90, *boxes)
        grids[page][rng.randrange(90), :] |= rng.random() < 0.3
    ink, pages = ink_of(spark, grids)
    got = leaves(xycut.xy_cut(ink, pages, share=0.015, least=5, ink_share=ink_share))
    want = {p: plain(g, 6, 0.015, 5, ink_share) for p, g in grids.items()}
    assert got == {p: x for p, x in want.items() if x}
    assert len(got[0]) == 64 and max(len(x) for x in want.values()) >= 64  # six levels were gone through


def test_touching_runs(spark):
    """The sweep finds each pair of touching runs once, and no other."""
    rng = np.random.default_rng(4)
    rows = [(p, y, [int(v) for v in rng.random(30) < 0.5]) for p in range(3) for y in range(12)]
    runs = components.ink_runs(spark.createDataFrame(rows, "page_id long, y int, ink array<int>"))
    own = runs.collect()
    for reach in (0, 1):
        got = sorted((r.page_id, r.run, r.other) for r in components.touching(runs, reach).collect())
        assert got == sorted((a.page_id, a.run, b.run) for a in own for b in own if a.page_id == b.page_id and b.y == a.y + 1 and a.l < b.r + reach and b.l < a.r + reach)
    assert components.touching(runs.filter(F.lit(False)), 1).count() == 0


def test_tables_stay_whole(spark):
    """A ruled table beside text is one leaf, though its rules are off the page that is cut; without the veto it falls into columns."""
    page = np.zeros((260, 330), bool)
    page[5:145, 5:155] = grids_.form(150, 140, 4, 4, text=False)
    for top, bottom, columns in ((25, 140, (20, 48, 76)), (5, 140, (200, 255)), (170, 255, (5, 60, 115, 170, 225, 265))):
        for y in range(top, bottom - 4, 9):
            for x in columns:
                page[y : y + 3, x : x + (14 if x < 100 and top == 25 else 50)] = True
    grids = {1: page, 2: page & (np.arange(330) < 150)}
    printed, pages = grids_.to_runs(spark, grids)
    ink = ruled.without_rules(printed).select("page_id", "l", F.col("y").alias("t"), "r", (F.col("y") + 1).alias("b"))
    clean = {p: grids_.decide(g)[1] for p, g in grids.items()}

    def is_table(p):
        return lambda box: min(box[2] - box[0], box[3] - box[1]) >= 100 and grids_.decide(grids[p][box[1] : box[3], box[0] : box[2]])[0][3] >= 2

    got = leaves(xycut.xy_cut(ink, pages, least=10, whole=lambda rects: ruled.whole_tables(printed, rects)))
    want = {p: plain(g.astype(int), 6, 0.015, 10, whole=is_table(p)) for p, g in clean.items()}
    assert got == want and len(want[1]) < len(plain(clean[1].astype(int), 6, 0.015, 10))
