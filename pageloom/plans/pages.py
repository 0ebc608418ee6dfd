"""Registered queries of the small page operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import page, raster
from .catalogue import B, P, _bits, _px, query
from .rasters import _listed, _rows
from .relations import HEIGHT, WIDTH, table


def _sum(weights) -> str:
    return "CAST(trunc(" + " + ".join(f"CAST({w} AS FLOAT) * CAST({c} AS FLOAT)" for w, c in zip(weights, ("v", "g", "u"), strict=True)) + " + CAST(0.5 AS FLOAT)) AS INT)"


@query(P + f", rgb AS (SELECT *, (v * 3 + y) % 256 AS g, (v * 7 + x) % 256 AS u FROM px) SELECT page_id, y, x, {_sum((0.3, 0.5, 0.2))} AS luminance, {_sum((0.25, 0.5, 0.25))} AS grey FROM rgb")
def colour_to_grey(spark, d):
    g, u = (F.col("v") * 3 + F.col("y")) % 256, (F.col("v") * 7 + F.col("x")) % 256
    return _px(spark, d).select("page_id", "y", "x", page.grey(F.col("v"), g, u).alias("luminance"), page.grey(F.col("v"), g, u, (1, 2, 1)).alias("grey"))


@query(P + f" SELECT page_id, CAST({WIDTH} - 1 - x AS INT) AS y, y AS x, v FROM px")
def rotate90_back(spark, d):
    return page.turned_back(_px(spark, d), WIDTH)


@query(P + " SELECT page_id, CAST(y - 3 AS INT) AS y, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY x) AS v FROM px WHERE x >= 5 AND x < 40 AND y >= 3 AND y < 9 GROUP BY page_id, y")
def crop(spark, d):
    return _listed(page.cropped(_rows(spark, d), 5, 3, 40, 9), "v")


@query(P + f""", spot AS (SELECT page_id, ys.y + 2 AS y, xs.x AS x, CASE WHEN ys.y < 0 THEN -ys.y - 1 WHEN ys.y >= {HEIGHT} THEN {2 * HEIGHT - 1} - ys.y ELSE ys.y END AS yy, CASE WHEN xs.x < 0 THEN -xs.x - 1 WHEN xs.x >= {WIDTH} THEN {2 * WIDTH - 1} - xs.x ELSE xs.x END AS xx
  FROM (SELECT DISTINCT page_id FROM px), (SELECT unnest(range(-2, {HEIGHT + 2})) AS y) ys, (SELECT unnest(range(-2, {WIDTH + 2})) AS x) xs)
SELECT spot.page_id, CAST(spot.y AS INT) AS y, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY spot.x) AS v FROM spot JOIN px ON spot.page_id = px.page_id AND yy = px.y AND xx = px.x GROUP BY spot.page_id, spot.y""")
def mirrored_border(spark, d):
    return _listed(page.mirrored(_rows(spark, d), 2), "v")


@query(B + """ SELECT page_id, 'x' AS axis, x AS "at", CAST(sum(ink) AS FLOAT) / CAST(count(*) AS FLOAT) > CAST(0.3 AS FLOAT) AS inked FROM bits GROUP BY page_id, x
UNION ALL SELECT page_id, 'y', y, CAST(sum(ink) AS FLOAT) / CAST(count(*) AS FLOAT) > CAST(0.3 AS FLOAT) FROM bits GROUP BY page_id, y""")
def ink_profiles(spark, d):
    bits = _bits(spark, d)
    across, down = (page.ink_flags(bits, axis, 0.3).select("page_id", F.lit(axis).alias("axis"), "at", "inked") for axis in "xy")
    return across.unionByName(down)


@query(P + """, h AS (SELECT page_id, v, count(*) AS c FROM px GROUP BY ALL), u AS (SELECT *, sum(c) OVER (PARTITION BY page_id ORDER BY v) AS s, greatest(1.0::DOUBLE, 0.75::DOUBLE * sum(c) OVER (PARTITION BY page_id)) AS target FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY v) AS k FROM u WHERE s >= target)
SELECT f.page_id, round(f.v + 1 - (f.s - target) / f.c, 9) AS ile, coalesce(h.c, 0) AS at_end FROM f LEFT JOIN h ON f.page_id = h.page_id AND h.v = 255 WHERE k = 1""")
def histogram_quantile(spark, d):
    hist = raster.histogram(_px(spark, d))
    ile = page.interpolated(hist, 0.75)
    ends = page.pile(hist, ile.select("page_id", F.lit(300).alias("v"))).select("page_id", F.col("c").alias("at_end"))
    return ile.join(ends, "page_id").select("page_id", F.round("ile", 9).alias("ile"), "at_end")


@query(P + """, s AS (SELECT page_id, y, sum(v) % 97 AS score FROM px GROUP BY page_id, y), o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, y) AS hi, row_number() OVER (PARTITION BY page_id ORDER BY score, y) AS lo FROM s)
SELECT page_id, CAST(max(score) AS BIGINT) AS greatest, max(CASE WHEN hi = 1 THEN y END) AS greatest_at, CAST(min(score) AS BIGINT) AS least, max(CASE WHEN lo = 1 THEN y END) AS least_at FROM o GROUP BY page_id""")
def first_extremes(spark, d):
    scores = _rows(spark, d).select("page_id", "y", (F.aggregate("v", F.lit(0), lambda a, v: a + v) % 97).cast("long").alias("score"))
    return page.extremes(scores, "page_id", "y", "score")


@query("""WITH b AS (SELECT l_suppkey AS page_id, l_orderkey * 10 + l_linenumber AS box, CAST(5 + l_partkey % 60 AS INT) AS w, CAST(CASE WHEN l_linenumber >= 5 THEN 15 + l_orderkey % 60 ELSE 10 + l_quantity % 4 END AS INT) AS h, l_linenumber >= 5 AS large FROM lineitem),
s AS (SELECT page_id, count(*) AS n, avg(h) AS mean, stddev_pop(h) AS sd FROM b WHERE NOT large GROUP BY page_id)
SELECT b.page_id, box, w, h FROM b JOIN s ON b.page_id = s.page_id WHERE large AND n >= 8 AND (sd = 0 OR (h - mean) / sd >= 4) AND h / mean BETWEEN 1.8 AND 6.0 AND w / h BETWEEN 0.25 AND 1.6""")
def large_initials(spark, d):
    n = F.col("l_linenumber")
    height = F.when(n >= 5, 15 + F.col("l_orderkey") % 60).otherwise(10 + F.col("l_quantity") % 4)
    own = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page_id"), (F.col("l_orderkey") * 10 + n).alias("box"), (5 + F.col("l_partkey") % 60).cast("int").alias("w"), height.cast("int").alias("h"), (n >= 5).alias("large"))
    return page.initials(own)
