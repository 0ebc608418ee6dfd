"""Registered queries of page layout; their SQL goes pixel by pixel or pair by pair where the operators sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import document, layout
from .catalogue import LINES, W, _words, query
from .relations import dealt, table


def _lines(spark, d) -> DataFrame:
    """Lines with the band of the page that they lie in."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", (24 * F.size(F.split("text", "\n"))).alias("high"))
    own = document.lines(_words(spark, d)).join(docs, "doc_id")
    return own.withColumn("band", document.band(F.col("t"), F.col("b"), F.col("high"))).drop("high", "text")


def _blocks(spark, d) -> DataFrame:
    """Blocks of six lines with a line's gap, every second one reaching into the one before, of four widths."""
    k = F.col("block")
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    own = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("(n + 6) div 7 - 1").cast("int"))).alias("block"))
    return own.select("doc_id", "block", F.lit(0).alias("l"), (168 * k - 24 * (k % 2)).alias("t"), (300 + 100 * (k % 4)).alias("r"), (168 * k + 144).alias("b"), (k % 3 == 1).alias("is_table"))


def _figures(spark, d) -> DataFrame:
    own = table(spark, d, "documents").filter("doc_id % 5 = 0")
    return own.select("doc_id", F.lit(0).alias("figure"), F.lit(700).alias("l"), F.lit(10).alias("t"), F.lit(820).alias("r"), F.lit(150).alias("b"))


PLACED = W + "," + LINES + """,
n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
banded AS (SELECT lines.*, CASE WHEN b <= round(24 * n * 0.08) THEN 'header' WHEN t >= 24 * n - round(24 * n * 0.08) AND b <= 24 * n THEN 'footer' END AS band, (l + r) // 2 AS x, (t + b) // 2 AS y FROM lines JOIN n ON lines.doc_id = n.doc_id),
blk AS (SELECT doc_id, k AS block, 0 AS l, 168 * k - 24 * (k % 2) AS t, 300 + 100 * (k % 4) AS r, 168 * k + 144 AS b, k % 3 = 1 AS is_table FROM (SELECT doc_id, unnest(range((n + 6) // 7)) AS k FROM n)),
hit AS (SELECT banded.doc_id, line_idx, min(block) AS block FROM banded JOIN blk ON banded.doc_id = blk.doc_id AND band IS NULL AND x >= blk.l AND x < blk.r AND y >= blk.t AND y < blk.b GROUP BY banded.doc_id, line_idx),
own AS (SELECT banded.*, hit.block, blk.is_table FROM banded LEFT JOIN hit ON banded.doc_id = hit.doc_id AND banded.line_idx = hit.line_idx LEFT JOIN blk ON hit.doc_id = blk.doc_id AND hit.block = blk.block),
reg AS (SELECT doc_id, CASE WHEN band = 'header' THEN 0 WHEN band = 'footer' THEN 4 WHEN block IS NULL THEN 2 ELSE 1 END AS part, coalesce(block, 0) AS n,
  max(coalesce(band, CASE WHEN is_table THEN 'table' ELSE 'text' END)) AS kind, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, string_agg(CAST(line_idx AS VARCHAR), ' ' ORDER BY line_idx) AS line_ids FROM own GROUP BY 1, 2, 3
  UNION ALL SELECT doc_id, 3, 0, 'figure', 700, 10, 820, 150, '' FROM documents WHERE doc_id % 5 = 0)"""


@query(PLACED + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, n) - 1 AS INT) AS region_idx, kind, l, t, r, b, line_ids FROM reg")
def page_regions(spark, d):
    return layout.regions(_lines(spark, d), _blocks(spark, d), _figures(spark, d))


def _table_words(spark, d) -> DataFrame:
    """An order's items as the rows of a table: four columns with ragged edges, the last of two words."""
    place = [("l_partkey", 0, 7), ("l_suppkey", 70, 31), ("l_quantity", 150, 23), ("l_orderkey", 240, 13), ("l_extendedprice", 300, 11)]
    word = lambda name, at, rag: F.struct(F.col("seed"), F.col(name).cast("bigint").cast("string").alias("text"), (at + F.col("l_partkey") % rag + F.col("l_linenumber")).cast("int").alias("l"))
    items = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), "l_orderkey")
    own = items.withColumn("table_id", F.col("l_orderkey")).withColumn("row", F.col("l_linenumber") - 1).withColumn("seed", F.col("l_linenumber") * 5 + F.col("l_partkey"))
    first = own.groupBy("table_id", "row").agg(*(F.min(word(*p)).alias(p[0]) for p in place))  # line numbers may repeat
    first = first.select("table_id", "row", F.posexplode(F.array(*(p[0] for p in place))).alias("word_idx", "w"))
    size = 10 * F.length("w.text")
    return first.select("table_id", "row", "word_idx", "w.text", "w.l", (24 * F.col("row")).alias("t"), (F.col("w.l") + size).alias("r"), (24 * F.col("row") + 8 + F.col("w.seed") % 5).cast("int").alias("b"), (40 + F.col("w.seed") % 61).cast("int").alias("conf"))


TABLE_WORDS = """WITH item AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS row, l_linenumber * 5 + l_partkey AS seed, u.* FROM lineitem, LATERAL (VALUES
    (0, CAST(l_partkey AS VARCHAR), 0 + l_partkey % 7 + l_linenumber), (1, CAST(l_suppkey AS VARCHAR), 70 + l_partkey % 31 + l_linenumber), (2, CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR), 150 + l_partkey % 23 + l_linenumber),
    (3, CAST(l_orderkey AS VARCHAR), 240 + l_partkey % 13 + l_linenumber), (4, CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR), 300 + l_partkey % 11 + l_linenumber)) u(word_idx, text, l)),
once AS (SELECT *, row_number() OVER (PARTITION BY table_id, row, word_idx ORDER BY seed, text, l) AS k FROM item),
tw AS (SELECT table_id, row, word_idx, text, CAST(l AS INT) AS l, CAST(24 * row AS INT) AS t, CAST(l + 10 * length(text) AS INT) AS r, CAST(24 * row + 8 + seed % 5 AS INT) AS b, CAST(40 + seed % 61 AS INT) AS conf FROM once WHERE k = 1)"""

GRID = TABLE_WORDS.replace("WITH item", "WITH RECURSIVE item") + """,
sh AS (SELECT table_id, min(l) AS x0, max(r) AS x1, count(DISTINCT row) AS n, list_sort(list(greatest(b - t, 1)))[count(*) // 2 + 1] AS high FROM tw GROUP BY table_id),
px AS (SELECT table_id, unnest(range(x0, x1)) AS x, x1, n, high FROM sh),
cov AS (SELECT table_id, x, count(DISTINCT row) AS c FROM (SELECT table_id, row, unnest(range(l, r)) AS x FROM tw) GROUP BY table_id, x),
bl AS (SELECT px.*, px.x - row_number() OVER (PARTITION BY px.table_id ORDER BY px.x) AS run FROM px LEFT JOIN cov ON px.table_id = cov.table_id AND px.x = cov.x WHERE n - coalesce(c, 0) >= n // 2 + 1),
gp AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY s) AS k FROM (SELECT table_id, min(x) AS s, max(x) + 1 AS e, any_value(high) AS high, any_value(x1) AS x1 FROM bl GROUP BY table_id, run) WHERE e < x1),
nx AS (SELECT *, coalesce(lead(s) OVER o - e < least(e - s, lead(e) OVER o - lead(s) OVER o) AND lead(s) OVER o - e < high, FALSE) AS near, lead(e) OVER o AS ne FROM gp WINDOW o AS (PARTITION BY table_id ORDER BY s)),
walk AS (SELECT table_id, list(struct_pack(s := s, e := e, near := near, ne := ne, high := high) ORDER BY s) AS g FROM nx GROUP BY table_id),
go AS (SELECT table_id, 1::BIGINT AS i, g FROM walk UNION ALL SELECT table_id, i + CASE WHEN g[i].near THEN 2 ELSE 1 END, g FROM go WHERE i + CASE WHEN g[i].near THEN 2 ELSE 1 END <= len(g)),
cut AS (SELECT table_id, (g[i].s + CASE WHEN g[i].near THEN g[i].ne ELSE g[i].e END) // 2 AS x FROM go WHERE CASE WHEN g[i].near THEN g[i].ne ELSE g[i].e END - g[i].s >= 2 * g[i].high),
put AS (SELECT tw.table_id, tw.row, tw.word_idx, any_value(tw.text) AS text, any_value(tw.l) AS l, any_value(tw.t) AS t, any_value(tw.r) AS r, any_value(tw.b) AS b, any_value(tw.conf) AS conf, count(cut.x) AS col
  FROM tw JOIN sh ON tw.table_id = sh.table_id LEFT JOIN cut ON tw.table_id = cut.table_id AND cut.x <= greatest(x0, least((l + r) // 2, greatest(x1, x0 + 1) - 1)) GROUP BY tw.table_id, tw.row, tw.word_idx)"""


@query(GRID + """ SELECT table_id, row, CAST(col AS INT) AS col, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, string_agg(text, ' ' ORDER BY word_idx) AS text, min(conf) AS conf, row = 0 AS header FROM put GROUP BY table_id, row, col""")
def table_grid(spark, d):
    return layout.table_cells(_table_words(spark, d))


@query(TABLE_WORDS + """,
px AS (SELECT DISTINCT table_id AS page_id, unnest(range(l, r)) AS x FROM tw), ext AS (SELECT table_id AS page_id, 300 + table_id % 1500 AS extent FROM tw GROUP BY table_id),
nx AS (SELECT page_id, x + 1 AS s, lead(x) OVER (PARTITION BY page_id ORDER BY x) AS e, min(x) OVER (PARTITION BY page_id) AS first, max(x) OVER (PARTITION BY page_id) + 1 AS last FROM px),
va AS (SELECT nx.*, extent, e - s >= greatest(ceil(CAST(0.015 AS FLOAT) * CAST(extent AS FLOAT)), 1) AS wide FROM nx JOIN ext ON nx.page_id = ext.page_id WHERE e > s),
pg AS (SELECT page_id, bool_or(wide) AS found, max(e - s) AS widest FROM va GROUP BY page_id),
fam AS (SELECT va.*, found, widest, CAST(e - s AS FLOAT) >= CAST(0.6 AS FLOAT) * CAST(widest AS FLOAT) AS family FROM va JOIN pg ON va.page_id = pg.page_id),
cnt AS (SELECT *, sum(CAST(family AS INT)) OVER (PARTITION BY page_id) AS n FROM fam),
cand AS (SELECT * FROM cnt WHERE wide OR (NOT found AND family AND n >= 2 AND CAST(widest AS FLOAT) >= CAST(0.05 AS FLOAT) * CAST(CAST(extent AS FLOAT) / CAST(n + 1 AS FLOAT) AS FLOAT))),
nb AS (SELECT *, s - coalesce(lag(e) OVER o, first) AS before, coalesce(lead(s) OVER o, last) - e AS behind FROM cand WINDOW o AS (PARTITION BY page_id ORDER BY s))
SELECT page_id, (s + e) // 2 AS cut, max(e - s) OVER (PARTITION BY page_id) AS thickness FROM nb WHERE before >= 24 AND behind >= 24""")
def axis_cuts(spark, d):
    own = _table_words(spark, d).select(F.col("table_id").alias("page_id"), F.col("l").cast("bigint").alias("s"), F.col("r").cast("bigint").alias("e"))
    return layout.axis_cuts(own, own.select("page_id", (300 + F.col("page_id") % 1500).alias("extent")).distinct())


def _cells(spark, d) -> DataFrame:
    """An order's items as blocks in columns, a few of double width."""
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    left = 130 * ((n * 3 + F.col("l_suppkey")) % 5) + F.col("l_suppkey") % 13
    width = F.when(F.col("l_quantity") > 40, 240).otherwise(100 + part % 8)
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), n.cast("bigint").alias("block"), left.alias("l"), (60 * (part % 2)).alias("t"), (left + width).alias("r"), (60 * (part % 2) + 20 + part % 40).alias("b"))
    return own.groupBy("page_id", "block").agg(F.min(F.struct("l", "t", "r", "b")).alias("x")).select("page_id", "block", "x.*")


CELLS = """WITH every AS (SELECT *, 130 * ((l_linenumber * 3 + l_suppkey) % 5) + l_suppkey % 13 AS l, 60 * (l_partkey % 2) AS t, CASE WHEN l_quantity > 40 THEN 240 ELSE 100 + l_partkey % 8 END AS w, 20 + l_partkey % 40 AS h FROM lineitem),
cell AS (SELECT page_id, block, l, t, r, b FROM (SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS block, l, t, l + w AS r, t + h AS b, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l, t, l + w, t + h) AS k FROM every) WHERE k = 1),
med AS (SELECT page_id, CAST(floor(median(r - l)) AS BIGINT) AS m FROM cell GROUP BY page_id HAVING count(*) >= 3),
ev AS (SELECT cell.*, m FROM cell JOIN med ON cell.page_id = med.page_id WHERE 4 * (r - l) >= 3 * m AND 4 * (r - l) <= 5 * m),
ed AS (SELECT page_id, l - lag(l) OVER (PARTITION BY page_id ORDER BY l) AS step, l FROM (SELECT DISTINCT page_id, l FROM ev)),
pit AS (SELECT page_id, min(l) AS x0, CAST(floor(median(step)) AS BIGINT) AS p FROM ed GROUP BY page_id),
sl AS (SELECT ev.*, x0, p, CAST(floor((l - x0) / p + 0.5) AS BIGINT) AS k FROM ev JOIN pit ON ev.page_id = pit.page_id WHERE p > 0 AND 10 * p >= 9 * m AND ev.page_id IN (SELECT page_id FROM ev GROUP BY page_id HAVING count(*) >= 3)),
lat AS (SELECT page_id, any_value(x0) AS x0, any_value(m) AS width, any_value(p) AS pitch, max(k) AS "last", CAST(floor(median(b - t)) AS BIGINT) AS high FROM sl WHERE 20 * abs(x0 + k * p - l) <= 3 * p
  GROUP BY page_id HAVING count(DISTINCT k) >= 3 AND max(k) >= 2 AND 2 * count(DISTINCT k) >= max(k) + 1)"""


@query(CELLS + " SELECT * FROM lat")
def column_lattice(spark, d):
    return layout.column_lattice(_cells(spark, d))


@query(CELLS + """,
co AS (SELECT page_id, k, x0 + k * pitch AS cl, x0 + k * pitch + width AS cr, (x0 + k * pitch + width + x0 + (k + 1) * pitch) // 2 AS bound, "last" FROM (SELECT *, unnest(range("last" + 1)) AS k FROM lat)),
sp AS (SELECT cell.page_id, block FROM cell JOIN co ON cell.page_id = co.page_id JOIN lat ON cell.page_id = lat.page_id WHERE 2 * (least(r, cr) - greatest(l, cl)) >= cr - cl AND 2 * (b - t) >= high GROUP BY cell.page_id, block HAVING count(*) >= 2),
edge AS (SELECT page_id, block, l AS x FROM cell UNION ALL SELECT page_id, block, r FROM cell
  UNION ALL SELECT cell.page_id, cell.block, bound FROM cell JOIN sp ON cell.page_id = sp.page_id AND cell.block = sp.block JOIN co ON cell.page_id = co.page_id WHERE bound > l AND bound < r AND k < "last"),
pr AS (SELECT page_id, block, row_number() OVER o - 1 AS part, x AS l, lead(x) OVER o AS r FROM edge WINDOW o AS (PARTITION BY page_id, block ORDER BY x))
SELECT pr.page_id, pr.block, CAST(part AS INT) AS part, pr.l, cell.t, pr.r, cell.b FROM pr JOIN cell ON pr.page_id = cell.page_id AND pr.block = cell.block WHERE pr.r IS NOT NULL""")
def split_on_lattice(spark, d):
    cells = _cells(spark, d)
    return layout.split_on_lattice(cells, layout.column_lattice(cells))


@query(W + "," + LINES + """,
ln AS (SELECT doc_id AS page_id, line_idx // 6 AS region, line_idx, l, CASE WHEN doc_id % 2 = 0 THEN 600 + line_idx % 9 ELSE r END AS r, CASE WHEN line_idx % 11 <> 10 THEN b * (1 + (line_idx // 6) % 3 * (doc_id % 2)) + line_idx % 3 END AS baseline FROM lines),
st AS (SELECT page_id, region, d FROM (SELECT *, baseline - lag(baseline) OVER (PARTITION BY page_id, region ORDER BY baseline) AS d FROM ln WHERE baseline IS NOT NULL) WHERE d > 0),
rp AS (SELECT page_id, region, list_sort(list(d))[count(*) // 2 + 1] AS pitch FROM st GROUP BY ALL), pp AS (SELECT page_id, list_sort(list(d))[count(*) // 2 + 1] AS page_pitch FROM st GROUP BY page_id HAVING count(*) >= 3),
lastline AS (SELECT page_id, region, max(line_idx) AS z FROM ln GROUP BY ALL),
g AS (SELECT ln.page_id, ln.region, count(baseline) AS n, count(*) AS k, max(CASE WHEN line_idx < z THEN r END) AS hi, min(CASE WHEN line_idx < z THEN r END) AS lo, min(l) AS l FROM ln JOIN lastline ON ln.page_id = lastline.page_id AND ln.region = lastline.region GROUP BY ln.page_id, ln.region),
a AS (SELECT g.*, CASE WHEN n >= 3 THEN pitch END AS pitch, page_pitch FROM g LEFT JOIN rp ON g.page_id = rp.page_id AND g.region = rp.region LEFT JOIN pp ON g.page_id = pp.page_id)
SELECT page_id, region, CAST(pitch AS BIGINT) AS pitch, CAST(page_pitch AS BIGINT) AS page_pitch, round(CASE WHEN pitch IS NULL OR page_pitch IS NULL OR pitch / page_pitch BETWEEN 0.8 AND 1.25 THEN 1.0 ELSE least(3.0, greatest(0.5, pitch / page_pitch)) END, 6) AS scale,
  CASE WHEN k >= 3 AND hi > l THEN 50 * (hi - lo) <= hi - l END AS justified FROM a""")
def region_pitch(spark, d):
    i, odd = F.col("line_idx"), F.col("doc_id") % 2
    group = F.expr("line_idx div 6")
    own = document.lines(_words(spark, d)).select(
        F.col("doc_id").alias("page_id"), group.alias("region"), "line_idx", "l", F.when(odd == 0, 600 + i % 9).otherwise(F.col("r")).alias("r"), F.when(i % 11 != 10, F.col("b") * (1 + group % 3 * odd) + i % 3).alias("baseline"),
    )
    out = layout.region_pitch(own)
    return out.select("page_id", "region", F.col("pitch").cast("bigint").alias("pitch"), F.col("page_pitch").cast("bigint").alias("page_pitch"), F.round("scale", 6).alias("scale"), "justified")


@query(W + "," + LINES + """,
ln AS (SELECT doc_id AS page_id, line_idx, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS k, 24 * line_idx + 30 * (line_idx // 5) AS t, 24 * line_idx + 30 * (line_idx // 5) + 20 + 2 * (doc_id % 3) AS b FROM lines),
rn AS (SELECT page_id, e AS s, nxt AS e FROM (SELECT page_id, b AS e, lead(t) OVER (PARTITION BY page_id ORDER BY t) AS nxt FROM ln) WHERE nxt > e),
iv AS (SELECT page_id, k, t + b AS c, lead(t + b) OVER (PARTITION BY page_id ORDER BY k) AS nc, lead(line_idx) OVER (PARTITION BY page_id ORDER BY k) AS nl FROM ln),
own AS (SELECT rn.page_id, min(iv.k) AS k, max(rn.e - rn.s) AS len FROM rn JOIN iv ON rn.page_id = iv.page_id AND rn.s + rn.e BETWEEN c AND nc GROUP BY rn.page_id, rn.s),
gap AS (SELECT iv.page_id, iv.nl, coalesce(max(len), 0) AS gap FROM iv LEFT JOIN own ON iv.page_id = own.page_id AND iv.k = own.k WHERE nl IS NOT NULL GROUP BY iv.page_id, iv.k, iv.nl),
md AS (SELECT page_id, greatest(list_sort(list(gap))[count(*) // 2 + 1], 1) AS m FROM gap GROUP BY page_id HAVING count(*) >= 2 AND CAST(count(*) FILTER (gap = 0) AS FLOAT) < CAST(0.3 AS FLOAT) * CAST(count(*) AS FLOAT))
SELECT gap.page_id, nl AS line_idx FROM gap JOIN md ON gap.page_id = md.page_id WHERE gap >= 2 * m""")
def paragraph_starts(spark, d):
    top = 24 * F.col("line_idx") + 30 * F.expr("line_idx div 5")
    own = document.lines(_words(spark, d)).select(F.col("doc_id").alias("page_id"), "line_idx", top.alias("t"), (top + 20 + 2 * (F.col("doc_id") % 3)).alias("b"))
    blank = layout.valleys(own.select("page_id", F.col("t").alias("s"), F.col("b").alias("e")))
    return layout.paragraph_starts(own, blank)


#: A value halfway between two decimals is lifted before it is rounded, for the sums behind it differ in their last bits.
SLOPES = "SELECT l_orderkey AS page_id, 100 * l_linenumber AS y, ((l_partkey % 7) - 3) * 0.004 + l_linenumber * 0.001 * (l_orderkey % 3) AS slope FROM lineitem"


@query(f"""WITH s AS ({SLOPES}), m AS (SELECT page_id, avg(y) AS my, avg(slope) AS ms FROM s GROUP BY page_id),
v AS (SELECT s.page_id, any_value(my) AS my, any_value(ms) AS ms, sum((y - my) * (slope - ms)) AS c, sum((y - my) * (y - my)) AS v FROM s JOIN m ON s.page_id = m.page_id GROUP BY s.page_id),
f AS (SELECT page_id, CASE WHEN v > 0 THEN ms - c / v * my ELSE ms END AS m0, CASE WHEN v > 0 THEN c / v ELSE 0.0 END AS m1 FROM v)
SELECT page_id, round(m0 + 1e-10, 6) + 0.0 AS m0, round(m1 + 1e-12, 8) + 0.0 AS m1, round(abs(m0), 9) > 0.0087 OR round(abs(m1) * 800, 9) > 0.0087 AS significant FROM f""")
def shear_ramp(spark, d):
    n = F.col("l_linenumber")
    slope = ((F.col("l_partkey") % 7) - 3) * F.lit(0.004) + n * F.lit(0.001) * (F.col("l_orderkey") % 3)
    ramp = layout.shear_ramp(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (100 * n).alias("y"), slope.alias("slope")), 800)
    return ramp.select("page_id", (F.round(F.col("m0") + 1e-10, 6) + 0.0).alias("m0"), (F.round(F.col("m1") + 1e-12, 8) + 0.0).alias("m1"), "significant")


@query(W + "," + LINES + """,
s AS (SELECT doc_id, line_idx, t AS y, CASE WHEN doc_id % 2 = 0 THEN 10 + 0.01 * t + line_idx % 3 * 0.1 ELSE 10 + line_idx % 3 END AS size FROM lines),
m AS (SELECT doc_id, avg(y) AS my, avg(size) AS ms FROM s GROUP BY doc_id),
v AS (SELECT s.doc_id, any_value(my) AS my, sum((y - my) * (size - ms)) AS c, sum((y - my) * (y - my)) AS v, sum((size - ms) * (size - ms)) AS w FROM s JOIN m ON s.doc_id = m.doc_id GROUP BY s.doc_id)
SELECT s.doc_id, line_idx, round(size - CASE WHEN v > 1e-9 AND (w <= 1e-9 OR c * c / (v * w) >= 0.5) THEN c / v * (y - my) ELSE 0 END + 1e-9, 5) AS size FROM s JOIN v ON s.doc_id = v.doc_id""")
def sizes_without_trend(spark, d):
    i = F.col("line_idx")
    size = F.when(F.col("doc_id") % 2 == 0, 10 + F.lit(0.01) * F.col("t") + i % 3 * F.lit(0.1)).otherwise(10 + i % 3)
    return layout.without_trend(document.lines(_words(spark, d)).select("doc_id", "line_idx", F.col("t").alias("y"), size.cast("double").alias("size"))).select("doc_id", "line_idx", F.round(F.col("size") + 1e-9, 5).alias("size"))
