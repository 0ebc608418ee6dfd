"""Registered queries on whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import document, fields, numeric, raster
from ..streaming import monitor
from .relations import HEIGHT, PIXELS_SQL, WORDS_SQL, pixels, table, words

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql.strip()
        return f

    return keep


def query_without_sql(f):
    """Registers a query whose rows SQL cannot give within reason; its tests compare it with a plain version."""
    QUERIES[f.__name__] = f
    return f


def _words(spark, d):
    return words(table(spark, d, "documents"))


def _px(spark, d):
    return pixels(table(spark, d, "documents"))


def _bits(spark, d):
    return raster.binarized(_px(spark, d))


W, P = "WITH" + WORDS_SQL, "WITH" + PIXELS_SQL
OTSU = """
h AS (SELECT page_id, v, count(*) AS c FROM px GROUP BY ALL),
u AS (SELECT page_id, v, sum(c) OVER o AS w0, sum(c * v) OVER o AS s0, sum(c) OVER p AS n, sum(c * v) OVER p AS s FROM h
      WINDOW o AS (PARTITION BY page_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY page_id)),
g AS (SELECT page_id, v, CAST(s0 * n - s * w0 AS DOUBLE) * CAST(s0 * n - s * w0 AS DOUBLE) / CAST(w0 * (n - w0) AS DOUBLE) AS score FROM u WHERE w0 < n),
th AS (SELECT page_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, v) AS k FROM g) WHERE k = 1)"""
B = P + "," + OTSU + """,
bits AS (SELECT px.page_id, y, x, CAST(v <= coalesce(threshold, -1) AS INT) AS ink FROM px LEFT JOIN th ON px.page_id = th.page_id)"""


@query(W + " SELECT *, mean_conf < 75 AS low FROM (SELECT documents.doc_id, count(words.doc_id) AS n_words, count(DISTINCT line_idx) AS n_lines, round(avg(conf), 4) AS mean_conf, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM documents LEFT JOIN words ON documents.doc_id = words.doc_id GROUP BY documents.doc_id)")
def doc_quality(spark, d):
    return document.quality(_words(spark, d), table(spark, d, "documents"))


LINES = """lines AS (SELECT doc_id, line_idx, string_agg(CASE WHEN leading_space THEN ' ' ELSE '' END || text, '' ORDER BY word_idx) AS text,
  min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, min(conf) AS conf FROM words GROUP BY doc_id, line_idx)"""


@query(W + "," + LINES + " SELECT * FROM lines")
def text_lines(spark, d):
    return document.lines(_words(spark, d))


@query(W + "," + LINES + " SELECT doc_id, string_agg(text || chr(10), '' ORDER BY line_idx) AS page FROM lines GROUP BY doc_id")
def render_text(spark, d):
    return document.page_text(_words(spark, d))


@query(W + """,
pg AS (SELECT doc_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM words GROUP BY doc_id),
ln AS (SELECT doc_id, line_idx, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS line_num FROM words GROUP BY doc_id, line_idx),
lev AS (SELECT doc_id, k AS level, 0 AS line_num, 0 AS word_num, l, t, r, b, -1 AS conf, '' AS text FROM pg, (SELECT unnest([1, 2, 3]) AS k)
  UNION ALL SELECT doc_id, 4, line_num, 0, l, t, r, b, -1, '' FROM ln
  UNION ALL SELECT w.doc_id, 5, line_num, row_number() OVER (PARTITION BY w.doc_id, w.line_idx ORDER BY word_idx), w.l, w.t, w.r, w.b, conf, text FROM words w JOIN ln ON w.doc_id = ln.doc_id AND w.line_idx = ln.line_idx)
SELECT doc_id, CAST(level AS INT) AS level, CAST(1 AS INT) AS page_num, CAST(level > 1 AS INT) AS block_num, CAST(level > 2 AS INT) AS par_num, CAST(line_num AS INT) AS line_num, CAST(word_num AS INT) AS word_num,
  l AS "left", t AS top, CAST(r - l AS INT) AS width, CAST(b - t AS INT) AS height, CAST(conf AS INT) AS conf, text FROM lev""")
def render_tsv(spark, d):
    return document.tsv(_words(spark, d))


ESCAPE = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')"""


BBOX = "'bbox ' || l || ' ' || t || ' ' || r || ' ' || b"
HOCR_HEAD, HOCR_META = document.HEAD, document.META.replace("'", "''")


@query(W + f""",
sz AS (SELECT doc_id, 'doc_' || doc_id AS name, coalesce(10 * list_max(list_transform(string_split(text, chr(10)), lambda s: length(s))), 0) AS w, coalesce(24 * len(string_split(text, chr(10))), 0) AS h FROM documents),
wd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, word_idx) AS k FROM words),
ln AS (SELECT doc_id, line_idx, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS k,
  string_agg(chr(10) || '      <span class=''ocrx_word'' id=''word_1_' || k || ''' title=''' || {BBOX} || '; x_wconf ' || conf || '''>' || {ESCAPE} || '</span>', '' ORDER BY word_idx) AS body FROM wd GROUP BY doc_id, line_idx),
pg AS (SELECT doc_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, string_agg(chr(10) || '     <span class=''ocr_line'' id=''line_1_' || k || ''' title="' || {BBOX} || '">' || body || chr(10) || '     </span>', '' ORDER BY line_idx) AS body FROM ln GROUP BY doc_id)
SELECT sz.doc_id, '{HOCR_HEAD}' || name || '{HOCR_META}' || name || '"; bbox 0 0 ' || w || ' ' || h || '; ppageno 0; scan_res 0 0''>' || chr(10)
  || CASE WHEN body IS NULL THEN '' ELSE '   <div class=''ocr_carea'' id=''block_1_1'' title="' || {BBOX} || '">' || chr(10) || '    <p class=''ocr_par'' id=''par_1_1'' title="' || {BBOX} || '">' || body || chr(10) || '    </p>' || chr(10) || '   </div>' || chr(10) END
  || '  </div>' || chr(10) || ' </body>' || chr(10) || '</html>' || chr(10) AS hocr FROM sz LEFT JOIN pg ON sz.doc_id = pg.doc_id""")
def render_hocr(spark, d):
    docs, ls = table(spark, d, "documents"), F.split("text", "\n")
    w, h = 10 * F.array_max(F.transform(ls, lambda s: F.length(s))), 24 * F.when(F.col("text").isNotNull(), F.size(ls))
    pages = docs.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.coalesce(w, F.lit(0)).alias("w"), F.coalesce(h, F.lit(0)).alias("h"))
    return document.hocr(words(docs), pages)


@query(W + " SELECT doc_id, CAST(((t + b) // 2) // 240 AS INT) AS block_row, CAST(((l + r) // 2) // 400 AS INT) AS block_col, count(*) AS n_words, min(conf) AS conf FROM words GROUP BY 1, 2, 3")
def regions(spark, d):
    return document.placed(_words(spark, d))


@query(W + """, s AS (SELECT doc_id, count(*)::HUGEINT AS n, sum(t)::HUGEINT AS x, sum(r - l)::HUGEINT AS y, sum(t::BIGINT * t)::HUGEINT AS xx, sum(t::BIGINT * (r - l))::HUGEINT AS xy, sum((r - l)::BIGINT * (r - l))::HUGEINT AS yy FROM words GROUP BY doc_id),
v AS (SELECT doc_id, (n * xx - x * x)::DOUBLE AS xx, (n * xy - x * y)::DOUBLE AS xy, (n * yy - y * y)::DOUBLE AS yy FROM s WHERE n * xx > x * x),
f AS (SELECT doc_id, xy / xx AS slope, CASE WHEN yy = 0 THEN 1.0::DOUBLE ELSE xy / xx * (xy / yy) END AS fit FROM v)
SELECT doc_id, round(slope + 1e-10::DOUBLE, 6) AS slope, round(fit + 1e-10::DOUBLE, 6) AS fit, fit >= 0.5 AS significant FROM f""")
def size_trend(spark, d):
    return document.trend(_words(spark, d))


@query(W + """, own AS (SELECT doc_id, line_idx, count(*) AS n, median(r - l) AS size FROM words GROUP BY 1, 2), well AS (SELECT doc_id, median(size) AS well FROM own WHERE n >= 10 GROUP BY 1)
SELECT own.doc_id, line_idx, n, round(CASE WHEN n >= 10 THEN size ELSE coalesce(well, size) END, 4) AS size FROM own LEFT JOIN well ON own.doc_id = well.doc_id""")
def font_sizes(spark, d):
    return document.font_sizes(_words(spark, d))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(coalesce(text, ''), '([.!?])[.!?]+', '\\1', 'g'), '[.!?](\\s|$)')) AS INT) AS ends,
  CAST(len(regexp_extract_all(coalesce(text, ''), '\\pL-\\n')) AS INT) AS wraps FROM documents""")
def sentences(spark, d):
    return document.sentences(table(spark, d, "documents"))


@query("""SELECT o_orderkey, token, CASE WHEN d >= 2 AND d > n AND n >= 1 THEN translate(token, 'OoIl|ZzSsBG', '00111225586') END AS hardened
FROM (SELECT *, length(regexp_replace(token, '[^0-9]', '', 'g')) AS d, length(regexp_replace(token, '[^A-Za-z|]', '', 'g')) AS n
      FROM (SELECT o_orderkey, translate(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), '015', 'OlS') AS token FROM orders))""")
def harden_numeric(spark, d):
    token = F.translate(F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), "015", "OlS").alias("token")
    return table(spark, d, "orders").select("o_orderkey", token).withColumn("hardened", tokens.hardened(F.col("token")))


AMOUNT = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(f"""SELECT o_orderkey, CAST(c // 100 AS VARCHAR) || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ' €' AS amount, c AS cents, (c // 100) * 100 AS whole
FROM (SELECT o_orderkey, {AMOUNT} AS c FROM orders)""")
def amount_cents(spark, d):
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    euros = F.expr("c div 100").cast("string")
    own = table(spark, d, "orders").select("o_orderkey", c.alias("c"))
    amount = F.concat(euros, F.lit(","), F.lpad((F.col("c") % 100).cast("string"), 2, "0"), F.lit(" €"))
    return own.select("o_orderkey", amount.alias("amount"), tokens.amount_cents(amount).alias("cents"), tokens.amount_cents(euros).alias("whole"))


@query("""SELECT c_custkey, 'DE' || lpad(CAST(98 - CAST((CAST(c_custkey AS HUGEINT) * 7919 * 1000000 + 131400) % 97 AS INT) AS VARCHAR), 2, '0') || lpad(CAST(c_custkey * 7919 AS VARCHAR), 18, '0') AS iban, TRUE AS valid, FALSE AS spoilt FROM customer""")
def iban_check(spark, d):
    body = F.lpad((F.col("c_custkey") * 7919).cast("string"), 18, "0")
    check = F.lpad((98 - tokens.mod97(F.concat(body, F.lit("131400")))).cast("string"), 2, "0")
    own = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("DE"), check, body).alias("iban"))
    spoilt = F.concat(F.expr("substring(iban, 1, 21)"), F.expr("cast((cast(substring(iban, 22, 1) as int) + 1) % 10 as string)"))
    return own.select("c_custkey", "iban", tokens.iban_valid(F.col("iban")).alias("valid"), tokens.iban_valid(spoilt).alias("spoilt"))


@query("""SELECT p_partkey, regexp_replace(translate(p_type || ' Nr.:', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[:.]+$', '') AS label, CAST(p_size AS INT) AS bare, CAST(p_size AS INT) AS dashed, CAST(p_size AS INT) AS of_pages, CAST(NULL AS INT) AS none FROM part""")
def labels_and_page_numbers(spark, d):
    n = F.col("p_size").cast("string")
    shapes = {"bare": n, "dashed": F.concat(F.lit("- "), n, F.lit(" -")), "of_pages": F.concat(F.lit("Seite "), n, F.lit(" von 99")), "none": F.concat(F.lit("seite "), n, F.lit(" von"))}
    name = tokens.label(F.concat("p_type", F.lit(" Nr.:"))).alias("label")
    return table(spark, d, "part").select("p_partkey", name, *(tokens.page_number(c).alias(k) for k, c in shapes.items()))


FURNITURE = """
own AS (SELECT o_orderkey AS doc_id, o_custkey AS c, o_orderkey % 7 AS head, o_custkey % 9 AS foot FROM orders),
hd AS (SELECT doc_id, CASE head WHEN 0 THEN 'Seite ' || c % 300 || ' von 300' WHEN 1 THEN 'Summe 12' WHEN 2 THEN repeat('long ', 13) || 'line' WHEN 3 THEN c % 90 || ' / 90' WHEN 4 THEN 'Chapter' WHEN 5 THEN '- ' || c % 70 || ' -' ELSE '99999' END AS text,
  CASE head WHEN 0 THEN c % 300 WHEN 3 THEN c % 90 WHEN 5 THEN c % 70 END AS n, head NOT IN (1, 2) AS kept FROM own),
ft AS (SELECT doc_id, CASE foot WHEN 0 THEN 'PAGE ' || c % 50 || ' of 50' WHEN 1 THEN 'Netto 7' WHEN 2 THEN CAST(c % 10000 AS VARCHAR) WHEN 3 THEN 'seite 3 von' WHEN 4 THEN 'page ' || c % 80 WHEN 5 THEN repeat('x', 61) WHEN 6 THEN repeat('y', 60) WHEN 7 THEN '12 / 0x' ELSE 'Brutto' END AS text,
  CASE foot WHEN 0 THEN c % 50 WHEN 2 THEN c % 10000 WHEN 4 THEN c % 80 END AS n, foot NOT IN (1, 5, 8) AS kept FROM own)"""


@query("WITH" + FURNITURE + """
SELECT hd.doc_id, CASE WHEN hd.kept THEN '0' ELSE '' END AS header_lines, CASE WHEN ft.kept THEN '12' ELSE '' END AS footer_lines, CAST(coalesce(ft.n, hd.n) AS INT) AS page_number,
  CAST(CASE WHEN ft.n IS NOT NULL THEN 12 WHEN hd.n IS NOT NULL THEN 0 END AS INT) AS page_number_line FROM hd JOIN ft ON hd.doc_id = ft.doc_id""")
def page_furniture(spark, d):
    c, key = F.col("o_custkey"), F.col("o_orderkey")
    pick = lambda n, *texts: F.element_at(F.array(*(F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in t)) for t in texts)), (n + 1).cast("int"))
    head = pick(key % 7, ("Seite ", c % 300, " von 300"), ("Summe 12",), ("long " * 13 + "line",), (c % 90, " / 90"), ("Chapter",), ("- ", c % 70, " -"), ("99999",))
    foot = pick(c % 9, ("PAGE ", c % 50, " of 50"), ("Netto 7",), (c % 10000,), ("seite 3 von",), ("page ", c % 80), ("x" * 61,), ("y" * 60,), ("12 / 0x",), ("Brutto",))
    docs = table(spark, d, "orders").select(key.alias("doc_id"), F.concat(head, F.lit("\n7" * 11 + "\n"), foot).alias("text"))
    return document.furniture(document.lines(words(docs)), height=13 * 24)


@query("""WITH tot AS (SELECT o_orderkey AS doc_id, CAST(round(o_totalprice * 100) AS BIGINT) AS g FROM orders) SELECT doc_id, g - g * 19 // 119 AS net, g * 19 // 119 AS vat, g AS gross, TRUE AS sums FROM tot""")
def harvest_fields(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("g"))
    own = own.withColumn("v", F.expr("g * 19 div 119"))

    def money(c):
        return F.concat(F.expr(f"({c}) div 100").cast("string"), F.lit(","), F.lpad(F.expr(f"({c}) % 100").cast("string"), 2, "0"))

    text = F.concat(F.lit("Netto: "), money("g - v"), F.lit(" USt "), money("v"), F.lit("\nBrutto: x "), money("g"))
    return fields.checked(fields.harvested(words(own.select("doc_id", text.alias("text")))))


@query("""WITH lex AS (SELECT word, count(*) AS weight FROM (SELECT unnest(string_split_regex(lower(text), '[^a-zà-ÿ]+')) AS word FROM benchmark) WHERE length(word) >= 3 GROUP BY word),
unk AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(p_name || ' ' || p_type), '[^a-zà-ÿ]+')) AS word FROM part) WHERE length(word) >= 4 AND word NOT IN (SELECT word FROM lex)),
c AS (SELECT u.word, l.word AS fixed, l.weight, levenshtein(u.word, l.word) AS d FROM unk u JOIN lex l ON abs(length(u.word) - length(l.word)) <= 1 WHERE levenshtein(u.word, l.word) <= 1)
SELECT word, fixed, CAST(d AS INT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, length(fixed), weight DESC, fixed) AS k FROM c) WHERE k = 1""")
def lexicon_correction(spark, d):
    def split(df, text):
        return df.select(F.explode(F.split(F.lower(text), "[^a-zà-ÿ]+")).alias("word"))

    lexicon = split(table(spark, d, "benchmark"), F.col("text")).filter("length(word) >= 3").groupBy("word").agg(F.count("*").alias("weight"))
    return fields.corrected(split(table(spark, d, "part"), F.concat_ws(" ", "p_name", "p_type")), lexicon)


@query("SELECT item_id, CAST(levenshtein(text, translate(text, 'e', 'c')) AS INT) AS errors, CAST(length(text) AS INT) AS chars FROM benchmark")
def char_error_rate(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.levenshtein("text", F.translate("text", "e", "c")).alias("errors"), F.length("text").alias("chars"))


@query("SELECT item_id, upper(hex(encode(text))) AS hex, base64(encode(text)) AS b64, " + ESCAPE + " AS escaped FROM benchmark")
def encodings(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.hex("text").alias("hex"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "").alias("b64"), tokens.markup_escaped(F.col("text")).alias("escaped"))


@query(P + " SELECT page_id, v, count(*) AS c FROM px GROUP BY ALL")
def pixel_histogram(spark, d):
    return raster.histogram(_px(spark, d))


@query(P + "," + OTSU + " SELECT * FROM th")
def otsu_threshold(spark, d):
    return raster.otsu(_px(spark, d))


@query(B + " SELECT page_id, CAST(sum(ink) AS BIGINT) AS ink, count(*) AS n FROM bits GROUP BY page_id")
def ink_fraction(spark, d):
    return _bits(spark, d).groupBy("page_id").agg(F.sum("ink").alias("ink"), F.count("*").alias("n"))


@query(B + " SELECT page_id, y, CAST(sum(ink) AS BIGINT) AS ink, count(*) AS extent FROM bits GROUP BY page_id, y")
def ink_rows(spark, d):
    return raster.row_profile(_bits(spark, d))


@query(B + " SELECT page_id, CAST(min(x) AS INT) AS l, CAST(min(y) AS INT) AS t, CAST(max(x) + 1 AS INT) AS r, CAST(max(y) + 1 AS INT) AS b, count(*) AS ink FROM bits WHERE ink = 1 GROUP BY page_id")
def ink_bbox(spark, d):
    return raster.ink_box(_bits(spark, d))


@query(P + """, a AS (SELECT page_id, y, x, sum(v) OVER o AS s, sum(v * v) OVER o AS q FROM px WINDOW o AS (PARTITION BY page_id, y ORDER BY x ROWS UNBOUNDED PRECEDING))
SELECT page_id, y, x, CAST(sum(s) OVER o AS BIGINT) AS s, CAST(sum(q) OVER o AS BIGINT) AS q FROM a WINDOW o AS (PARTITION BY page_id, x ORDER BY y ROWS UNBOUNDED PRECEDING)""")
def integral_image(spark, d):
    return raster.integral(_px(spark, d))


@query(P + " SELECT page_id, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, CAST(sum(v) // 4 AS BIGINT) AS v FROM px GROUP BY 1, 2, 3")
def scale_half(spark, d):
    return raster.halved(_px(spark, d))


@query(B + " SELECT page_id, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, CAST(sum(ink) >= 2 AS INT) AS ink FROM bits GROUP BY 1, 2, 3")
def rank_reduce(spark, d):
    return raster.rank_reduced(_bits(spark, d), 2)


@query(P + f" SELECT page_id, x AS y, CAST({HEIGHT} - 1 - y AS INT) AS x, v FROM px")
def rotate90(spark, d):
    return raster.turned(_px(spark, d), HEIGHT)


@query(B + """, r AS (SELECT page_id, y, sum(ink) AS ink FROM bits GROUP BY 1, 2), s AS (SELECT page_id, ink - lag(ink) OVER (PARTITION BY page_id ORDER BY y) AS d FROM r)
SELECT page_id, CAST(coalesce(sum(d * d), 0) AS BIGINT) AS score FROM s GROUP BY page_id""")
def skew_score(spark, d):
    return raster.square_sum(_bits(spark, d))


@query(B + """, r AS (SELECT page_id, y, sum(ink) AS ink FROM bits GROUP BY 1, 2 HAVING sum(ink) > 0), i AS (SELECT *, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS island FROM r)
SELECT page_id, CAST(min(y) AS INT) AS top, CAST(max(y) + 1 AS INT) AS bottom FROM i GROUP BY page_id, island HAVING max(y) + 1 - min(y) >= 3""")
def line_runs(spark, d):
    return raster.runs(_bits(spark, d), 3)


@query(P + """, h AS (SELECT page_id, v, count(*) AS c FROM px GROUP BY ALL), m AS (SELECT *, CASE WHEN v = min(v) OVER (PARTITION BY page_id) THEN 256 ELSE v END AS tie FROM h),
k AS (SELECT page_id, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY c DESC, tie DESC) AS i FROM m) WHERE i = 1),
s AS (SELECT page_id, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, median(v) AS median, list_sort(list(v))[count(*) // 2 + 1] AS upper_median, round(quantile_cont(v, 0.9), 4) AS p90 FROM px GROUP BY page_id)
SELECT k.page_id, mode, mean, sd, median, upper_median, p90 FROM k JOIN s ON k.page_id = s.page_id""")
def pixel_statistics(spark, d):
    return raster.statistics(_px(spark, d))


VEC = "v AS (SELECT vec_id, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS p FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)), q AS (SELECT vec_id, i, CAST(greatest(-127, least(127, round(p * 127))) AS INT) AS q FROM v)"


@query("WITH " + VEC + " SELECT * FROM q")
def quantize_i8(spark, d):
    return numeric.quantized(table(spark, d, "embeddings"))


@query("WITH " + VEC + " SELECT vec_id, i, q, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS rank FROM q) WHERE rank <= 5")
def top_outputs(spark, d):
    return numeric.top_outputs(table(spark, d, "embeddings"))


@query("WITH " + VEC + ", e AS (SELECT vec_id, exp(greatest(p - max(p) OVER (PARTITION BY vec_id), -86.0)) AS e FROM v), s AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS s FROM e) SELECT vec_id, round(max(s), 8) AS top, round(-sum(s * ln(s)), 6) AS entropy FROM s GROUP BY vec_id")
def softmax(spark, d):
    return numeric.softmax(table(spark, d, "embeddings"))


@query("WITH " + VEC + " SELECT vec_id, CAST(r.r AS INT) AS row, CAST(sum(((7 * r.r + 3 * i) % 11 - 5) * q) AS BIGINT) AS product FROM q, (SELECT unnest(range(4)) AS r) r GROUP BY 1, 2")
def matrix_vector(spark, d):
    return numeric.products(table(spark, d, "embeddings"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_monitor(spark, d):
    return monitor.windowed(table(spark, d, "events"))
