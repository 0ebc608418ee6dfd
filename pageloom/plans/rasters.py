"""Registered queries on page rows; their SQL takes neighbours by joins on pixels, not by windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, raster, rows
from .catalogue import B, P, query
from .relations import HEIGHT, WIDTH, page_rows, table


def _rows(spark, d):
    return page_rows(table(spark, d, "documents"))


def _graded(spark, d):
    """Rows with their values and their ink."""
    grey = _rows(spark, d)
    cut = F.coalesce("threshold", F.lit(-1))
    return grey.join(raster.otsu(rows.exploded(grey)), "page_id", "left").select("page_id", "y", "v", F.transform("v", lambda v: (v <= cut).cast("int")).alias("ink"))


def _ink(spark, d):
    return _graded(spark, d).drop("v")


def dilation(out: str, own: str, w: int, h: int) -> str:
    """SQL of a table: the source pixels that the brick would carry to a pixel."""
    return f"""{out} AS (SELECT a.page_id, a.y, a.x, max(b.ink) AS ink FROM {own} a JOIN {own} b ON a.page_id = b.page_id
  AND b.x BETWEEN a.x - {w - 1 - w // 2} AND a.x + {w // 2} AND b.y BETWEEN a.y - {h - 1 - h // 2} AND a.y + {h // 2} GROUP BY a.page_id, a.y, a.x)"""


def erosion(out: str, own: str, w: int, h: int) -> str:
    return f"""{out} AS (SELECT a.page_id, a.y, a.x, CAST(sum(b.ink) = {w * h} AS INT) AS ink FROM {own} a JOIN {own} b ON a.page_id = b.page_id
  AND b.x BETWEEN a.x - {w // 2} AND a.x + {w - 1 - w // 2} AND b.y BETWEEN a.y - {h // 2} AND a.y + {h - 1 - h // 2} GROUP BY a.page_id, a.y, a.x)"""


def safe_closing(out: str, own: str, w: int, h: int) -> str:
    """SQL of two tables: ink carried to any place, on the page or off it, and pixels whose whole brick is covered."""
    return f"""{out}_far AS (SELECT DISTINCT page_id, y + oy - {h // 2} AS y, x + ox - {w // 2} AS x FROM {own}, (SELECT unnest(range({w})) AS ox), (SELECT unnest(range({h})) AS oy) WHERE ink = 1),
{out} AS (SELECT a.page_id, a.y, a.x, CAST(count(s.x) = {w * h} AS INT) AS ink FROM {own} a LEFT JOIN {out}_far s ON a.page_id = s.page_id
  AND s.x BETWEEN a.x - {w // 2} AND a.x + {w - 1 - w // 2} AND s.y BETWEEN a.y - {h // 2} AND a.y + {h - 1 - h // 2} GROUP BY a.page_id, a.y, a.x)"""


def drawing(own: str) -> str:
    return f" SELECT page_id, CAST(y AS INT) AS y, string_agg(CAST(ink AS VARCHAR), '' ORDER BY x) AS bits FROM {own} GROUP BY page_id, y"


@query(B + "," + dilation("o", "bits", 3, 2) + " SELECT * FROM o")
def morph_dilate(spark, d):
    return rows.exploded(rows.dilated(_ink(spark, d), 3, 2), "ink")


@query(B + "," + erosion("o", "bits", 2, 3) + " SELECT * FROM o")
def morph_erode(spark, d):
    return rows.exploded(rows.eroded(_ink(spark, d), 2, 3), "ink")


@query(B + "," + dilation("o", "bits", 4, 5) + drawing("o"))
def rows_dilate(spark, d):
    return rows.drawn(rows.dilated(_ink(spark, d), 4, 5))


@query(B + "," + erosion("o", "bits", 3, 4) + drawing("o"))
def rows_erode(spark, d):
    return rows.drawn(rows.eroded(_ink(spark, d), 3, 4))


@query(B + "," + erosion("e", "bits", 2, 2) + "," + dilation("o", "e", 2, 2) + drawing("o"))
def rows_open(spark, d):
    return rows.drawn(rows.opened(_ink(spark, d), 2, 2))


@query(B + "," + dilation("e", "bits", 4, 3) + "," + erosion("o", "e", 4, 3) + drawing("o"))
def rows_close(spark, d):
    return rows.drawn(rows.closed(_ink(spark, d), 4, 3))


@query(B + "," + safe_closing("o", "bits", 4, 3) + drawing("o"))
def rows_close_safe(spark, d):
    return rows.drawn(rows.closed_safely(_ink(spark, d), 4, 3))


def reduction(out: str, own: str, level: int) -> str:
    return f"{out} AS (SELECT page_id, y // 2 AS y, x // 2 AS x, CAST(sum(ink) >= {level} AS INT) AS ink FROM {own} GROUP BY page_id, y // 2, x // 2 HAVING count(*) = 4)"


def replication(out: str, own: str, across: int, down: int) -> str:
    return f"{out} AS (SELECT page_id, y * {down} + oy AS y, x * {across} + ox AS x, ink FROM {own}, (SELECT unnest(range({across})) AS ox), (SELECT unnest(range({down})) AS oy))"


@query(B + "," + reduction("r1", "bits", 1) + "," + reduction("r2", "r1", 3) + drawing("r2"))
def rank_cascade(spark, d):
    return rows.drawn(rows.rank_cascade(_ink(spark, d), [1, 3, 0, 2]))


@query(B + "," + replication("o", "bits", 3, 2) + drawing("o"))
def rows_replicate(spark, d):
    return rows.drawn(rows.replicated(_ink(spark, d), 3, 2))


@query(B + "," + replication("o", "bits", 4, 4) + drawing("o"))
def rows_expand_power2(spark, d):
    return rows.drawn(rows.replicated(_ink(spark, d), 4, 4))


@query(B + "," + dilation("s1", "bits", 3, 1) + "," + reduction("s2", "s1", 2) + "," + replication("s3", "s2", 2, 2) + "," + safe_closing("s4", "s3", 2, 3) + drawing("s4"))
def morph_sequence(spark, d):
    return rows.drawn(rows.sequenced(_ink(spark, d), "d3.1 + R2 + x2 + c2.3"))


@query(B + "," + dilation("o", "bits", 3, 3) + ", s AS (SELECT o.page_id, o.y, o.x, CAST(o.ink = 1 AND bits.ink = 0 AS INT) AS ink FROM o JOIN bits USING (page_id, y, x))" + drawing("s"))
def ink_outline(spark, d):
    ink = _ink(spark, d)
    return rows.drawn(rows.subtracted(rows.dilated(ink, 3, 3), ink))


@query(B + "," + erosion("e", "bits", 1, 3) + "," + erosion("f", "bits", 3, 1) + ", s AS (SELECT e.page_id, e.y, e.x, CAST(NOT (e.ink = 1 OR f.ink = 1) AS INT) AS ink FROM e JOIN f USING (page_id, y, x))" + drawing("s"))
def ink_without_strokes(spark, d):
    ink = _ink(spark, d)
    return rows.drawn(rows.inverted(rows.united(rows.eroded(ink, 1, 3), rows.eroded(ink, 3, 1))))


@query(P + " SELECT page_id, y, string_agg(CAST(CAST(v < 128 AS INT) AS VARCHAR), '' ORDER BY x) AS bits FROM px GROUP BY page_id, y")
def fixed_threshold(spark, d):
    return rows.drawn(_rows(spark, d).select("page_id", "y", F.transform("v", lambda v: (v < 128).cast("int")).alias("ink")))


K = 2
WINDOWS = f""",
nb AS (SELECT page_id, y, x, v, CASE WHEN y + oy < 0 THEN -(y + oy) - 1 WHEN y + oy >= {HEIGHT} THEN {2 * HEIGHT - 1} - y - oy ELSE y + oy END AS yy,
  CASE WHEN x + ox < 0 THEN -(x + ox) - 1 WHEN x + ox >= {WIDTH} THEN {2 * WIDTH - 1} - x - ox ELSE x + ox END AS xx
  FROM px, (SELECT unnest(range({-K}, {K + 1})) AS oy), (SELECT unnest(range({-K}, {K + 1})) AS ox)),
st AS (SELECT nb.page_id, nb.y, nb.x, any_value(nb.v) AS v, CAST(trunc(CAST(1 AS FLOAT) / CAST({(2 * K + 1) ** 2} AS FLOAT) * CAST(sum(o.v) AS FLOAT)) AS INT) AS m,
  CAST(floor(sum(o.v * o.v) * (1.0::DOUBLE / {(2 * K + 1) ** 2}) + 0.5) AS INT) AS q
  FROM nb JOIN px o ON nb.page_id = o.page_id AND nb.yy = o.y AND nb.xx = o.x GROUP BY nb.page_id, nb.y, nb.x),
sd AS (SELECT *, CASE WHEN q >= m * m THEN CAST(sqrt(CAST(q - m * m AS FLOAT)) AS FLOAT) END AS sd FROM st),
pg AS (SELECT page_id, max(sd) AS most, CAST(min(v) AS FLOAT) AS least FROM sd GROUP BY page_id),
lt AS (SELECT page_id, y, x, v, m, q,
  coalesce(((CAST(trunc(m * (1.0::DOUBLE - CAST(CAST(0.34 AS FLOAT) AS DOUBLE) * (1.0::DOUBLE - CAST(sd AS DOUBLE) / 128.0::DOUBLE))) AS INT) % 256) + 256) % 256, 0) AS sauvola,
  coalesce(CAST(trunc(least(255.0::FLOAT, greatest(0.0::FLOAT, CAST(m AS FLOAT) + CAST(0.5 AS FLOAT) * ((CASE WHEN most > 0 THEN sd / most ELSE 0::FLOAT END) - 1::FLOAT) * (CAST(m AS FLOAT) - least)))) AS INT), 0) AS wolf,
  CAST(trunc(least(255.0::FLOAT, greatest(0.0::FLOAT, (mn + CAST(0.06 AS FLOAT) * ((CASE WHEN 1::FLOAT - vn + mn > 1.1920929e-07 THEN mn * (vn - mn) / (1::FLOAT - vn + mn) ELSE 1::FLOAT END) - mn)) * 255::FLOAT))) AS INT) AS singh
  FROM (SELECT *, CAST(v AS FLOAT) / 255::FLOAT AS vn, CAST(m AS FLOAT) / 255::FLOAT AS mn FROM sd) JOIN pg USING (page_id))"""


def _listed(df, *names):
    return df.select("page_id", "y", *(F.array_join(F.transform(n, lambda v: v.cast("string")), " ").alias(n) for n in names))


def _lists(*names: str) -> str:
    return ", ".join(f"string_agg(CAST({n} AS VARCHAR), ' ' ORDER BY x) AS {n}" for n in names)


@query(P + WINDOWS + " SELECT page_id, y, x, m AS mean FROM st")
def windowed_mean(spark, d):
    return rows.exploded(rows.window_statistics(_rows(spark, d), K), "m").withColumnRenamed("m", "mean")


@query(P + WINDOWS + f" SELECT page_id, y, {_lists('m', 'q')} FROM st GROUP BY page_id, y")
def mirrored_windows(spark, d):
    return _listed(rows.window_statistics(_rows(spark, d), K), "m", "q")


@query(P + WINDOWS + f" SELECT page_id, y, {_lists('sauvola', 'wolf', 'singh')} FROM lt GROUP BY page_id, y")
def local_thresholds(spark, d):
    return _listed(rows.local_thresholds(_rows(spark, d), K), "sauvola", "wolf", "singh")


@query(B + WINDOWS + """,
fr AS (SELECT page_id, avg(bits.ink) AS o, avg(CAST(v < sauvola AS INT)) AS s, avg(CAST(v < wolf AS INT)) AS w FROM bits JOIN lt USING (page_id, y, x) GROUP BY page_id),
md AS (SELECT page_id, CASE WHEN o BETWEEN 0.005 AND 0.15 THEN 'otsu' WHEN s BETWEEN 0.005 AND 0.15 THEN 'sauvola' WHEN w BETWEEN 0.005 AND 0.15 THEN 'wolf' ELSE 'singh' END AS mode FROM fr)
SELECT page_id, mode, y, string_agg(CASE mode WHEN 'otsu' THEN ink WHEN 'sauvola' THEN CAST(v < sauvola AS INT) WHEN 'wolf' THEN CAST(v < wolf AS INT) ELSE CAST(v < singh AS INT) END, '' ORDER BY x) AS bits
FROM bits JOIN lt USING (page_id, y, x) JOIN md USING (page_id) GROUP BY page_id, mode, y""")
def binarize_ladder(spark, d):
    out = rows.laddered(_graded(spark, d), K)
    return out.select("page_id", "mode", "y", F.array_join(F.transform("ink", lambda v: v.cast("string")), "").alias("bits"))


def connected(reach: int) -> str:
    """SQL of runs and of the first run that each is connected with, by reachability."""
    return f""",
rn AS (SELECT page_id, y, min(x) AS l, max(x) + 1 AS r FROM (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS i FROM bits WHERE ink = 1) GROUP BY page_id, y, i),
rr AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, l) AS run FROM rn),
lk AS (SELECT a.page_id, a.run AS a, b.run AS b FROM rr a JOIN rr b ON a.page_id = b.page_id AND abs(a.y - b.y) = 1 AND a.l < b.r + {reach} AND b.l < a.r + {reach}),
rc AS (SELECT page_id, run, run AS seen FROM rr UNION SELECT rc.page_id, rc.run, lk.b FROM rc JOIN lk ON rc.page_id = lk.page_id AND rc.seen = lk.a),
lb AS (SELECT rr.page_id, rr.run, y, l, r, label FROM rr JOIN (SELECT page_id, run, min(seen) AS label FROM rc GROUP BY ALL) m ON rr.page_id = m.page_id AND rr.run = m.run),
cc AS (SELECT page_id, label, min(l) AS l, min(y) AS t, max(r) AS r, max(y) + 1 AS b, sum(r - l) AS px FROM lb GROUP BY page_id, label)"""


REACHING = B.replace("WITH", "WITH RECURSIVE", 1)


@query(REACHING + connected(1) + " SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY label) - 1 AS comp, l, t, r, b, CAST(px AS BIGINT) AS px FROM cc")
def ink_components(spark, d):
    return components.components(components.labelled(components.ink_runs(_ink(spark, d)), 8)).drop("label")


@query(REACHING + connected(0) + " SELECT lb.page_id, lb.y, lb.l, lb.r FROM lb JOIN cc ON lb.page_id = cc.page_id AND lb.label = cc.label WHERE cc.r - cc.l >= 3 AND cc.b - cc.t >= 2")
def components_by_size(spark, d):
    return components.selected(components.labelled(components.ink_runs(_ink(spark, d)), 4), 3, 2).select("page_id", "y", "l", "r")


@query(REACHING + connected(1) + " SELECT page_id, y, l, r FROM lb WHERE EXISTS (SELECT 1 FROM lb s WHERE s.page_id = lb.page_id AND s.label = lb.label AND s.y = 0)")
def seed_fill(spark, d):
    ink = _ink(spark, d)
    seeds = rows.exploded(ink.filter("y = 0"), "ink").filter("ink = 1").select("page_id", "y", "x")
    return components.filled(components.labelled(components.ink_runs(ink), 8), seeds).select("page_id", "y", "l", "r")
