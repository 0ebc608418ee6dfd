"""Run algebra, ruled tables and page masks against plain versions on pixel grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.operators import masks, ruled, runs
from pageloom.plans import segments

SCHEMA = "page_id long, w int, h int, y int, l int, r int"


def to_runs(spark, grids):
    out = []
    for page, grid in grids.items():
        for y, row in enumerate(grid):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(int), [0]])))
            out += [(page, grid.shape[1], grid.shape[0], y, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    return spark.createDataFrame(out, SCHEMA), spark.createDataFrame([(p, g.shape[1], g.shape[0]) for p, g in grids.items()], "page_id long, w int, h int")


def to_grids(df, shapes):
    out = {p: np.zeros(s, bool) for p, s in shapes.items()}
    for r in df.collect():
        assert out[r.page_id].shape == (r.h, r.w) and not out[r.page_id][r.y, r.l : r.r].any() and 0 <= r.l < r.r <= r.w
        out[r.page_id][r.y, r.l : r.r] = True
    return out


def shifted(grid, dy, dx, fill=False):
    out = np.full_like(grid, fill)
    h, w = grid.shape
    ys, xs = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    ys2, xs2 = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = grid[ys2, xs2]
    return out


def dilate(grid, w, h):
    out = np.zeros_like(grid)
    for dy in range(-(h // 2), h - h // 2):
        for dx in range(-(w // 2), w - w // 2):
            out |= shifted(grid, dy, dx)
    return out


def erode(grid, w, h):
    out = np.ones_like(grid)
    for dy in range(-(h // 2), h - h // 2):
        for dx in range(-(w // 2), w - w // 2):
            out &= shifted(grid, -dy, -dx)
    return out


def opening(grid, w, h):
    return dilate(erode(grid, w, h), w, h)


def closing(grid, w, h):
    n = max(w, h)
    return erode(dilate(np.pad(grid, n), w, h), w, h)[n:-n, n:-n]


def labels(grid, connectivity=8):
    """Component number of each ink pixel (0: paper), in raster order."""
    out, n = np.zeros(grid.shape, int), 0
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (connectivity == 8 or not (dy and dx))]
    for y, x in zip(*np.nonzero(grid)):
        if out[y, x]:
            continue
        n += 1
        out[y, x], stack = n, [(y, x)]
        while stack:
            a, b = stack.pop()
            for dy, dx in near:
                c, d = a + dy, b + dx
                if 0 <= c < grid.shape[0] and 0 <= d < grid.shape[1] and grid[c, d] and not out[c, d]:
                    out[c, d] = n
                    stack.append((c, d))
    return out


def filled(seeds, mask, connectivity=8):
    own = labels(mask, connectivity)
    return np.isin(own, own[seeds & mask]) & mask


def reduced(grid, level):
    h, w = (n - n % 2 for n in grid.shape)
    return grid[:h, :w].reshape(h // 2, 2, w // 2, 2).sum((1, 3)) >= level


def of_components(grid, step, connectivity=8, width=1, height=1):
    own, out = labels(grid, connectivity), np.zeros_like(grid)
    for k in range(1, own.max() + 1):
        ys, xs = np.nonzero(own == k)
        box = slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1)
        if xs.max() + 1 - xs.min() >= width and ys.max() + 1 - ys.min() >= height:
            out[box] |= step((own == k)[box])
    return out


def chosen(grid, test, connectivity=8):
    own, out = labels(grid, connectivity), np.zeros_like(grid)
    for k in range(1, own.max() + 1):
        ys, xs = np.nonzero(own == k)
        if test(xs.max() + 1 - xs.min(), ys.max() + 1 - ys.min()):
            out |= own == k
    return out


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(8)
    return {1: rng.random((13, 17)) < 0.3, 2: rng.random((9, 20)) < 0.6, 3: np.zeros((5, 6), bool), 4: np.ones((6, 5), bool), 5: rng.random((1, 7)) < 0.5, 6: rng.random((7, 1)) < 0.5, 7: rng.random((16, 16)) < 0.5}


STEPS = {
    "dilated": (lambda r, p: runs.dilated(r, 4, 3), lambda g: dilate(g, 4, 3)),
    "eroded": (lambda r, p: runs.eroded(r, 2, 3), lambda g: erode(g, 2, 3)),
    "opened": (lambda r, p: runs.opened(r, 2, 2), lambda g: opening(g, 2, 2)),
    "opened along rows": (lambda r, p: runs.opened(r, 3, 1), lambda g: opening(g, 3, 1)),
    "opened along columns": (lambda r, p: runs.opened(r, 1, 3), lambda g: opening(g, 1, 3)),
    "closed": (lambda r, p: runs.closed(r, 3, 4), lambda g: closing(g, 3, 4)),
    "closed along rows": (lambda r, p: runs.closed(r, 4, 1), lambda g: closing(g, 4, 1)),
    "closed along columns": (lambda r, p: runs.closed(r, 1, 3), lambda g: closing(g, 1, 3)),
    "inverted": (runs.inverted, lambda g: ~g),
    "united": (lambda r, p: runs.united(r, runs.transposed(runs.transposed(runs.eroded(r, 2, 1)))), lambda g: g | erode(g, 2, 1)),
    "subtracted": (lambda r, p: runs.subtracted(r, runs.opened(r, 2, 1)), lambda g: g & ~opening(g, 2, 1)),
    "filled": (lambda r, p: runs.seed_filled(runs.opened(r, 3, 1), r, 4), lambda g: filled(opening(g, 3, 1), g, 4)),
    "by component": (lambda r, p: runs.by_component(r, lambda x: runs.dilated(runs.closed(x, 3, 3), 2, 1), 4, 2, 2), lambda g: of_components(g, lambda x: dilate(closing(x, 3, 3), 2, 1), 4, 2, 2)),
    "selected": (lambda r, p: runs.selected(r, F.expr("r - l >= 2 and b - t >= 3"), 4), lambda g: chosen(g, lambda w, h: w >= 2 and h >= 3, 4)),
}


@pytest.mark.parametrize("name", STEPS)
def test_steps(spark, grids, name):
    own, plain = STEPS[name]
    got = to_grids(own(*to_runs(spark, grids)), {p: g.shape for p, g in grids.items()})
    for p, g in grids.items():
        assert (got[p] == plain(g)).all(), p


@pytest.mark.parametrize("level", [1, 2, 3, 4])
def test_scales(spark, grids, level):
    own, _ = to_runs(spark, grids)
    got = to_grids(runs.rank_reduced(own, level), {p: (g.shape[0] // 2, g.shape[1] // 2) for p, g in grids.items()})
    large = to_grids(runs.replicated(own, 3), {p: (g.shape[0] * 3, g.shape[1] * 3) for p, g in grids.items()})
    for p, g in grids.items():
        assert (got[p] == reduced(g, level)).all() and (large[p] == g.repeat(3, 0).repeat(3, 1)).all()


def form(w, h, across, down, text=True, seed=0):
    """A page with rules and words, some of which touch a rule."""
    rng, grid = np.random.default_rng(seed), np.zeros((h, w), bool)
    for k in range(across):
        grid[15 + 30 * k : 17 + 30 * k, 4 : w - 5] = True
        grid[15 + 30 * k, 60:62] = False  # one of two rows is broken
    for k in range(down):
        grid[6 : h - 5, 8 + 28 * k : 10 + 28 * k] = True
    for _ in range(40 if text else 0):
        y, x = rng.integers(0, h - 8), rng.integers(0, w - 14)
        grid[y : y + 3, x : x + rng.integers(3, 13)] = True
    return grid


def decide(grid):
    across = closing(opening(grid, 100, 1), 1, 4)
    down = closing(opening(grid, 1, 100), 4, 1)
    off = grid & ~(filled(across, grid) | filled(down, grid))
    text = opening(closing(off, 4, 1), 8, 1)
    lanes = labels(opening(reduced(~text, 1), 1, 100))
    wide = sum(int(np.ptp(np.nonzero(lanes == k)[1])) + 1 >= 5 for k in range(1, lanes.max() + 1))
    n = int(labels(across).max()), int(labels(down).max()), int(wide)
    return (*n, (n[0] > 1) + (n[1] > 2) + (n[2] > 3) + (n[2] > 6)), off


def columns(w, h, n):
    """Text in columns, without rules: seen by its white corridors."""
    grid = np.zeros((h, w), bool)
    for k in range(n):
        for y in range(2, h - 3, 6):
            grid[y : y + 4, 4 + k * 28 : 18 + k * 28] = True
    return grid


def test_tables(spark):
    grids = {1: form(150, 140, 4, 4), 2: form(150, 140, 2, 0, seed=1), 3: form(150, 140, 0, 3, seed=2), 4: form(150, 140, 1, 1, seed=3), 5: columns(240, 230, 8), 6: columns(160, 230, 4), 7: np.zeros((120, 110), bool), 8: form(90, 140, 3, 3)}
    own, pages = to_runs(spark, grids)
    want = {p: decide(g) for p, g in grids.items()}
    got = {r.page_id: (r.nhb, r.nvb, r.nvw, r.score) for r in ruled.decided(own, pages).collect()}
    assert got == {p: x[0] for p, x in want.items()}
    assert {p for p, x in want.items() if x[0][3] >= 2} == {1, 5} and want[5][0][0] == 0 and want[1][0][:2] == (4, 4)
    clean = to_grids(ruled.without_rules(own), {p: g.shape for p, g in grids.items()})
    assert all((clean[p] == want[p][1]).all() for p in grids)

    box = {p: (0, 0, g.shape[1], g.shape[0]) for p, g in grids.items()} | {9: None}
    regions = [(p, 0, *b) for p, b in box.items() if b] + [(1, 1, -5, -5, 500, 500), (1, 2, 20, 20, 119, 140), (1, 3, 0, 0, 110, 110)]
    regions = spark.createDataFrame(regions, "page_id long, region int, l int, t int, r int, b int")
    part = decide(grids[1][0:110, 0:110])[0][3] >= 2
    tables = {(r.page_id, r.region) for r in ruled.tables(own, regions).collect()}
    assert tables == {(1, 0), (1, 1), (5, 0)} | ({(1, 3)} if part else set())
    assert {(r.page_id, r.region) for r in ruled.tables(own, regions, ruled=True).collect()} == tables - {(5, 0)}


def test_repainted(spark):
    rng = np.random.default_rng(5)
    grids = {1: form(120, 115, 2, 1, seed=6), 2: np.ones((101, 101), bool)}
    grey = {p: np.where(g, rng.integers(0, 90, g.shape), rng.integers(150, 256, g.shape)) for p, g in grids.items()}
    own, _ = to_runs(spark, grids)
    px = spark.createDataFrame([(p, y, x, int(v)) for p, g in grey.items() for (y, x), v in np.ndenumerate(g)], "page_id long, y int, x int, v int")
    got = {p: np.zeros(g.shape, int) for p, g in grids.items()}
    for r in ruled.repainted(px, own, ruled.without_rules(own)).collect():
        got[r.page_id][r.y, r.x] = r.v
    for p, g in grids.items():
        gone, want = g & ~decide(g)[1], grey[p].copy()
        middle = lambda v: int(np.sort(v)[len(v) // 2]) if len(v) else None
        for y in range(g.shape[0]):
            fill = middle(grey[p][y][~g[y]])
            fill = fill if fill is not None else middle(grey[p][~g])
            want[y][gone[y]] = 255 if fill is None else fill
        assert (got[p] == want).all() and gone.any()


def printed(seed, picture=True, columns=2):
    """A page of 340 x 280 with a picture, a speckled one for odd seeds, and columns of words in lines."""
    rng, grid = np.random.default_rng(seed), np.zeros((281, 343), bool)
    if picture:
        grid[30:110, 30:130] = rng.random((80, 100)) < (0.97 if seed % 2 else 1.1)
    for c in range(columns):
        for y in range(20 if c or not picture else 130, 262, 12):
            for x in range(0, 60, 24):
                left = (30, 160, 250)[(c + 1) % 3] + x
                grid[y : y + 5, left : left + 14 + int(rng.integers(0, 5))] = True
    return grid


def masks_of(grid):
    """(halftone, textline, textblock) by plain steps."""
    half = reduced(grid, 1)
    seeds = opening(reduced(reduced(half, 4), 4), 5, 5).repeat(4, 0).repeat(4, 1)
    h, w = seeds.shape
    mask = filled(seeds, closing(half, 4, 4)[:h, :w], 4)
    text = half.copy()
    text[:h, :w] &= ~mask
    paper = ~text
    lanes = opening(opening(paper & ~opening(paper, 80, 60), 5, 1), 1, 200)
    lines = opening(closing(text, 30, 1) & ~lanes, 3, 3)
    solid = of_components(opening(closing(lines, 1, 10), 4, 1), lambda x: dilate(closing(x, 30, 30), 3, 3))
    blocks = chosen(closing(solid, 10, 1) & ~lanes, lambda a, b: a >= 25 and b >= 5)
    blocks = chosen(blocks, lambda a, b: a >= 60 or b >= 60, 4)
    twice = lambda g: g.repeat(2, 0).repeat(2, 1)
    big = twice(mask)
    return big | filled(big, grid[: big.shape[0], : big.shape[1]], 8), dilate(twice(lines), 3, 3), dilate(twice(blocks), 3, 3)


def test_masks(spark):
    grids = {1: printed(1), 2: printed(2, columns=3), 3: printed(3, picture=False), 4: np.zeros((220, 210), bool), 5: printed(5)[:150, :190]}
    own, pages = to_runs(spark, grids)
    found, want = masks.regions(own, pages), {p: masks_of(g) for p, g in grids.items() if p != 5}
    for k, kind in enumerate(("halftone", "textline", "textblock")):
        got = to_grids(found[kind], {p: x[k].shape for p, x in want.items()})  # a page that is too small at half size has no masks
        for p in want:
            assert (got[p] == want[p][k]).all(), (kind, p)
    assert want[1][0].any() and not want[3][0].any() and want[1][2].any() and want[2][1].any()
    boxes = sorted((r.page_id, r.figure, r.l, r.t, r.r, r.b) for r in masks.figures(found["halftone"]).collect())
    assert [b[:2] for b in boxes] == [(1, 0), (2, 0)] and all(abs(x - y) <= 2 for x, y in zip(boxes[0][2:], (30, 30, 130, 110)))


def test_mask_queries(spark):
    """The registered pages, some with pictures and some without, against plain steps."""
    boxes, pages = segments._prints(spark, "/root/testdata/sf0.001")
    grids = {r.page_id: np.zeros((r.h, r.w), bool) for r in pages.collect()}
    for r in boxes.collect():
        grids[r.page_id][r.t : r.b, r.l : r.r] = True
    want = {p: masks_of(g) for p, g in list(grids.items())[:4]}
    got = {}
    for r in segments.page_masks(spark, "/root/testdata/sf0.001").collect():
        got[r.page_id, r["mask"], r.y] = (r.ink, r.first, r.last)
    for p, masks_ in want.items():
        for kind, grid in zip(("halftone", "textline", "textblock"), masks_, strict=True):
            for y, row in enumerate(grid):
                at = np.flatnonzero(row)
                assert got.get((p, kind, y)) == ((len(at), at[0], at[-1] + 1) if len(at) else None), (p, kind, y)
    assert any(w[0].any() for w in want.values()) and not all(w[0].any() for w in want.values())


def test_figures_take_only_the_mask_of_pictures(spark, monkeypatch):
    """Boxes of the pictures of the registered pages, without a text line or block being looked for."""
    boxes, pages = segments._prints(spark, "/root/testdata/sf0.001")
    few = boxes.filter("page_id <= 4")
    want = []
    for p in sorted({r.page_id for r in few.select("page_id").distinct().collect()}):
        grid = np.zeros((280, 340), bool)
        for r in few.filter(f"page_id = {p}").collect():
            grid[r.t : r.b, r.l : r.r] = True
        at = np.argwhere(masks_of(grid)[0])
        if len(at):
            want.append((p, 0, at[:, 1].min(), at[:, 0].min(), at[:, 1].max() + 1, at[:, 0].max() + 1))
    monkeypatch.setattr(masks, "text_lines", None)
    got = sorted((r.page_id, r.figure, r.l, r.t, r.r, r.b) for r in segments.page_figures(spark, "/root/testdata/sf0.001").filter("page_id <= 4").collect())
    assert want and got == want
