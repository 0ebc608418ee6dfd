"""Registered queries of box, number and text functions, sentences and page JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import document
from .catalogue import LINES, W, _words, query
from .relations import table


@query("""SELECT l_orderkey, l_linenumber, greatest(0, least(60, a)) AS l, greatest(0, least(90, 90 - t)) AS t, greatest(greatest(0, least(60, a)), least(60, r)) AS r, greatest(greatest(0, least(90, 90 - t)), least(90, 90 - b)) AS b,
  greatest(greatest(0, least(60, a)), least(60, r)) - greatest(0, least(60, a)) AS w, greatest(greatest(0, least(90, 90 - t)), least(90, 90 - b)) - greatest(0, least(90, 90 - t)) AS h
FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 80 - 10 AS INT) AS a, CAST(l_suppkey % 110 - 10 AS INT) AS b, CAST(l_partkey % 80 - 10 + l_linenumber * 4 AS INT) AS r, CAST(l_suppkey % 110 - 10 + l_linenumber * 5 AS INT) AS t FROM lineitem)""")
def image_boxes(spark, d):
    part, supp, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    left, low = (part % 80 - 10).cast("int"), (supp % 110 - 10).cast("int")
    own = boxes.box(left, (low + n * 5).cast("int"), (left + n * 4).cast("int"), low)
    rect = boxes.image_rect(own, F.lit(60), F.lit(90))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", boxes.image_box(own, F.lit(60), F.lit(90)).alias("i"), rect.alias("q")).select("l_orderkey", "l_linenumber", "i.*", "q.w", "q.h")


@query(W + """, nx AS (SELECT a.*, b.l AS l2, b.t AS t2, b.r AS r2, b.b AS b2 FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.line_idx = b.line_idx AND b.word_idx = a.word_idx + 1)
SELECT doc_id, line_idx, word_idx, '[' || l || ',' || t || ',' || greatest(r, r2) || ',' || greatest(b, b2) || ']' AS both_json, TRUE AS banded,
  'left:' || l || 'px;top:' || t || 'px;width:' || (r - l) || 'px;height:20px' AS css,
  printf('left:%.3f%%;top:%.3f%%;width:%.3f%%;height:%.3f%%', l / 2000.0::DOUBLE * 100, t / 3000.0::DOUBLE * 100, (r - l) / 2000.0::DOUBLE * 100, 20 / 3000.0::DOUBLE * 100) AS css_percent,
  round(r * 72.0::DOUBLE / 300, 3) AS right_pt FROM nx""")
def neighbour_boxes(spark, d):
    nearest = F.lead(F.struct("word_idx", F.struct("l", "t", "r", "b").alias("box"))).over(Window.partitionBy("doc_id", "line_idx").orderBy("word_idx"))
    own = _words(spark, d).filter("doc_id is not null").withColumn("next", nearest).filter(F.col("next.word_idx") == F.col("word_idx") + 1)
    a, b = F.struct("l", "t", "r", "b"), F.col("next.box")
    return own.select(
        "doc_id", "line_idx", "word_idx", boxes.json_box(boxes.union(a, b)).alias("both_json"), boxes.same_band(a, b).alias("banded"), boxes.css_box(a).alias("css"),
        boxes.percent_box(a, F.lit(2000), F.lit(3000)).alias("css_percent"), F.round(boxes.points(a["r"], F.lit(300)), 3).alias("right_pt"),
    )


@query("""SELECT event_id, CASE WHEN p > exp(-20.0::DOUBLE) THEN round(ln(p), 9) ELSE -20 END AS certainty, round(least(100, greatest(0, 100 + 5 * least(-v, v / 3 - 9))), 9) AS confidence,
  CASE WHEN event_id % 7 = 0 THEN '—' ELSE CAST(CAST(floor(v + 0.5) AS INT) AS VARCHAR) END AS shown, greatest(0, v - 9) AS relu, least(1, greatest(0, v / 9)) AS unit, least(1, greatest(-1, (v - 9) / 9)) AS symmetric,
  round((least(1, greatest(0, v / 100)) + least(1, greatest(0, v / 9))) / 2, 9) AS frequency, round(least(0.99::DOUBLE, event_id / (event_id + 1.0::DOUBLE)), 9) AS confidence_of, v >= 9 * 0.75 AND v <= 9 * 1.25 AS near,
  CAST(floor(event_id % 100 * 0.75 - user_id % 100 * 0.5 + 0.5) AS BIGINT) AS x, CAST(floor(user_id % 100 * 0.75 + event_id % 100 * 0.5 + 0.5) AS BIGINT) AS y,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN round(v * 4 / 3, 9) ELSE round(v + 2, 9) END AS font_px
FROM (SELECT event_id, user_id, round(abs(coalesce(value, 0)), 2) AS v, CASE WHEN event_id % 11 = 0 THEN 0.0::DOUBLE ELSE event_id / (event_id + 10.0::DOUBLE) END AS p FROM events)""")
def figures(spark, d):
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("v")
    own = table(spark, d, "events").withColumn("v", F.round(F.abs(F.coalesce("value", F.lit(0.0))), 2))
    p = F.when(e % 11 == 0, 0.0).otherwise(e / (e + 10.0))
    truth = boxes.truth(v, v / 9, e)
    turned = boxes.rotated(e % 100, u % 100, F.lit(0.75), F.lit(0.5))
    metrics = boxes.text_metrics(F.when(e % 3 != 0, v), F.lit(3.0), F.lit(1.0), v, F.when(e % 5 == 0, v))
    return own.select(
        "event_id", F.round(boxes.certainty(p), 9).alias("certainty"), F.round(boxes.confidence(F.array(-v, v / 3 - 9)), 9).alias("confidence"), boxes.confidence_text(F.when(e % 7 == 0, -1.0).otherwise(v)).alias("shown"),
        F.greatest(F.lit(0.0), v - 9).alias("relu"), boxes.clipped(v / 9, F.lit(0.0), F.lit(1.0)).alias("unit"), boxes.clipped((v - 9) / 9, F.lit(-1.0), F.lit(1.0)).alias("symmetric"),
        F.round(truth["frequency"], 9).alias("frequency"), F.round(truth["confidence"], 9).alias("confidence_of"), boxes.within_margin(v, F.lit(9.0), 0.25).alias("near"), turned["x"].alias("x"), turned["y"].alias("y"), F.round(metrics["font_px"], 9).alias("font_px"),
    )


@query("""WITH own AS (SELECT p_partkey, k, CASE k WHEN 0 THEN '(' || upper(p_type) || '),' WHEN 1 THEN '«' || upper(p_name[1]) || lower(p_name[2:]) || '»' WHEN 2 THEN lower(p_brand) || '!' ELSE '12-' || p_size END AS token FROM part, (SELECT unnest(range(4)) AS k))
SELECT p_partkey, CAST(k AS INT) AS k, CASE k WHEN 0 THEN '(' WHEN 1 THEN '«' ELSE regexp_extract(token, '^([^a-zA-Z]*)', 1) END AS prefix, regexp_extract(token, '([a-zA-Z](.*[a-zA-Z])?)', 1) AS core,
  CASE k WHEN 0 THEN '),' WHEN 1 THEN regexp_extract(token, '([^a-zA-Z]*)$', 1) WHEN 2 THEN regexp_extract(token, '([^a-zA-Z]*)$', 1) ELSE '' END AS suffix,
  CASE k WHEN 0 THEN 'WORD' WHEN 1 THEN 'Word' ELSE 'word' END AS cased, CAST(CASE WHEN length(token) >= 8 THEN 2 ELSE 1 END AS INT) AS edits FROM own""")
def token_parts(spark, d):
    name = F.concat(F.lit("«"), F.upper(F.substring("p_name", 1, 1)), F.lower(F.substring("p_name", 2, 999)), F.lit("»"))
    made = F.array(F.concat(F.lit("("), F.upper("p_type"), F.lit("),")), name, F.concat(F.lower("p_brand"), F.lit("!")), F.concat(F.lit("12-"), F.col("p_size").cast("string")))
    own = table(spark, d, "part").select("p_partkey", F.posexplode(made).alias("k", "token"))
    parts = boxes.core(F.col("token"))
    return own.select("p_partkey", "k", parts["prefix"].alias("prefix"), parts["core"].alias("core"), parts["suffix"].alias("suffix"), boxes.cased_like(parts["core"], F.lit("word")).alias("cased"), boxes.edits_allowed(F.length("token"), 1, 2).alias("edits"))


@query("""SELECT page_id, length(coalesce(html, '')) AS n, replace(replace(replace(replace(replace(html, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS escaped,
  md5(coalesce(url, '')) AS back, FALSE AS guid_of_url, TRUE AS guid_of_hash FROM pages""")
def json_strings(spark, d):
    h = F.md5(F.col("page_id").cast("string"))
    cut = lambda a, n: F.substring(h, a, n)
    guid = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    coded = F.translate(F.regexp_replace(F.base64(F.encode(F.coalesce("url", F.lit("")), "UTF-8")), "[\r\n=]", ""), "+/", "-_")
    return table(spark, d, "pages").select(
        "page_id", F.length(F.coalesce("html", F.lit(""))).cast("long").alias("n"), boxes.json_text(F.col("html")).alias("escaped"), F.md5(boxes.decoded_base64(coded)).alias("back"),
        F.coalesce(boxes.like_guid(F.col("url")), F.lit(False)).alias("guid_of_url"), boxes.like_guid(guid).alias("guid_of_hash"),
    )


MARK = "chr(1)"


@query(W + "," + LINES + f""",
pg AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_idx) || chr(10) AS text FROM lines GROUP BY doc_id),
jn AS (SELECT doc_id, replace(regexp_replace(text, '(\\p{{L}})-\\n', '\\1', 'g'), chr(10), ' ') AS text FROM pg),
sp AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\f]+', '\\1' || {MARK}, 'g'), {MARK}), lambda s: trim(s)), lambda s: s <> '') AS s FROM jn)
SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS sent_idx, unnest(s) AS text FROM sp""")
def sentence_texts(spark, d):
    return document.assembled(document.lines(_words(spark, d)))


@query(W + "," + LINES + """,
ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS n FROM lines)
SELECT doc_id, CAST(count(*) AS INT) AS n_lines, '[' || min(l) || ',' || min(t) || ',' || max(r) || ',' || max(b) || ']' AS box,
  '[' || string_agg('{"text":"' || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r') || '","bbox":[' || l || ',' || t || ',' || r || ',' || b || ']}', ',' ORDER BY n) || ']' AS lines_json FROM ln GROUP BY doc_id""")
def page_json(spark, d):
    return document.json_lines(document.lines(_words(spark, d)))
