"""Scaling and sharpening against plain loops in single precision."""

import numpy as np

from pageloom.operators import scaling

f32 = np.float32


def plain(g, f):
    """The page scaled by ``f``, by loops over target pixels."""
    h, w = g.shape
    if f == 1:
        return g
    wd, hd = int(f32(f) * f32(w) + f32(0.5)), int(f32(f) * f32(h) + f32(0.5))
    sx, sy = f32(16) * f32(w) / f32(wd), f32(16) * f32(h) / f32(hd)
    out = np.zeros((hd, wd), int)
    if f >= f32(0.7):
        for i in range(hd):
            for j in range(wd):
                a, b = int(sy * f32(i)), int(sx * f32(j))
                y, x, p, q = a >> 4, b >> 4, a & 15, b & 15
                y1, x1 = min(y + 1, h - 1), min(x + 1, w - 1)
                out[i, j] = ((16 - q) * (16 - p) * g[y, x] + q * (16 - p) * g[y, x1] + (16 - q) * p * g[y1, x] + q * p * g[y1, x1] + 128) // 256
        return sharp(out, 2, 0.4) if f < f32(1.4) else out
    if f in scaling.HALVINGS:
        for _ in range(scaling.HALVINGS[f]):
            g = g[: g.shape[0] // 2 * 2, : g.shape[1] // 2 * 2]
            g = (g[::2, ::2] + g[1::2, ::2] + g[::2, 1::2] + g[1::2, 1::2]) >> 2
        return sharp(g, 1, 0.2) if f > 0.2 else g
    for i in range(hd):
        for j in range(wd):
            a, b, c, d = int(sy * f32(i)), int(float(sy) * (i + 1)), int(sx * f32(j)), int(float(sx) * (j + 1))
            if b >> 4 > h - 2 or d >> 4 > w - 2:
                out[i, j] = g[a >> 4, c >> 4]
                continue
            wy = [16 - (a & 15), *[16] * ((b >> 4) - (a >> 4) - 1), b & 15]
            wx = [16 - (c & 15), *[16] * ((d >> 4) - (c >> 4) - 1), d & 15]
            part = g[a >> 4 : (b >> 4) + 1, c >> 4 : (d >> 4) + 1]
            out[i, j] = (int((np.outer(wy, wx) * part).sum()) + 128) // (sum(wy) * sum(wx))
    return sharp(out, 1, 0.2) if f > f32(0.2) else out


def sharp(g, n, strength):
    out = g.copy()
    for i in range(n, g.shape[0] - n):
        for j in range(n, g.shape[1] - n):
            mean = f32(1.0 / (2 * n + 1) ** 2) * f32(g[i - n : i + n + 1, j - n : j + n + 1].sum())
            moved = f32(g[i, j]) + f32(strength) * (f32(g[i, j]) - mean)
            out[i, j] = min(255, max(0, int(float(moved) + 0.5)))
    return out


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.page_id, {})[r.y, r.x] = r.v
    return {p: np.array([[v[y, x] for x in range(max(k[1] for k in v) + 1)] for y in range(max(k[0] for k in v) + 1)]) for p, v in out.items()}


def test_factors(spark):
    rng = np.random.default_rng(3)
    factors = [1.0, 0.7, 0.83, 1.2, 1.4, 2.0, 3.1, 0.69, 0.6, 0.5, 0.25, 0.125, 0.31, 0.21, 0.2, 0.11, 0.4]
    grids = {p: (rng.integers(0, 256, (20 + p, 27 + 2 * p)), f) for p, f in enumerate(factors)} | {90: (rng.integers(0, 256, (2, 3)), 1.3), 91: (rng.integers(0, 256, (3, 2)), 0.6), 92: (rng.integers(0, 256, (1, 1)), 2.0)}
    px = spark.createDataFrame([(p, y, x, int(v)) for p, (g, _) in grids.items() for (y, x), v in np.ndenumerate(g)], "page_id long, y int, x int, v int")
    pages = spark.createDataFrame([(p, g.shape[1], g.shape[0], f) for p, (g, f) in grids.items()] + [(99, 10, 10, 0.001)], "page_id long, w int, h int, f double")
    got = gathered(scaling.scaled(px, pages))
    assert got.keys() == grids.keys()
    for p, (g, f) in grids.items():
        want = plain(g, f)
        assert got[p].shape == want.shape and (got[p] == want).all(), (p, f)
    tall = gathered(scaling.to_height(px, pages.filter("page_id < 5"), 24))
    assert all((tall[p] == plain(grids[p][0], f32(24) / f32(grids[p][0].shape[0]))).all() for p in range(5))
