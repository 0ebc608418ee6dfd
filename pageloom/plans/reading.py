"""Registered queries on readings: fields by rules, edit operations and confusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, fields
from ..streaming import arrivals
from .catalogue import query, query_without_sql
from .relations import dealt, table


def _invoice_words(spark, d) -> DataFrame:
    """An order as an invoice of five lines, some with values out of the label's band, without tax, with wrong sums or wrong IBANs."""
    o = F.col("o_orderkey")
    own = dealt(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    own = own.select(o.alias("doc_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("g"), F.format_string("%018d", o * 7919 + 13).alias("bban"))
    own = own.withColumn("v", F.expr("g * 19 div 119"))
    rest = 98 - (F.concat("bban", F.lit("131400")).cast("decimal(38,0)") % 97).cast("int")
    own = own.withColumn("iban", F.concat(F.lit("DE"), F.lpad(F.when(F.col("doc_id") % 2 == 0, rest).otherwise((rest + 5) % 97).cast("string"), 2, "0"), "bban"))
    money = lambda c: F.concat(F.expr(f"({c}) div 100").cast("string"), F.lit(","), F.lpad(F.expr(f"({c}) % 100").cast("string"), 2, "0"))
    word = lambda line, k, text, shift=F.lit(0), when=F.lit(True): F.when(when, F.struct(F.lit(line).alias("line_idx"), F.lit(k).alias("word_idx"), text.alias("text"), shift.alias("shift")))
    part = lambda i, n: F.substring("iban", i, n)
    five, seven = F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0
    words = [
        word(0, 0, F.lit("Rechnungsnr.:")), word(0, 1, F.concat(F.lit("R"), F.col("doc_id").cast("string"))), word(0, 2, F.when(five, F.lit("K7")).otherwise(F.lit("vom,"))), word(0, 3, F.lit("heute")),
        word(1, 0, F.lit("Netto:")), word(1, 1, money("g - v + 100"), F.when(five, 15).otherwise(0), five), word(1, 2, F.lit("EUR")), word(1, 3, money("g - v")),
        word(2, 0, F.lit("MwSt")), word(2, 1, F.lit("19%")), word(2, 2, money("v"), when=~seven),
        word(3, 0, F.lit("Summe:"), when=seven), word(3, 1, F.lit("Gesamt")), word(3, 2, money("g + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END")),
        word(4, 0, F.lit("IBAN:")), *(word(4, 1 + k, part(1 + 4 * k, 4)) for k in range(6)), word(4, 7, F.lit("bei,")), word(4, 8, F.lit("Bank")), word(5, 0, F.lit("iban")), word(5, 1, F.lit("none")),
    ]
    own = own.select("doc_id", F.inline(F.array_compact(F.array(*words))))
    left = 100 * F.col("word_idx")
    return own.select("doc_id", "line_idx", "word_idx", "text", left.alias("l"), (24 * F.col("line_idx") + F.col("shift")).alias("t"), (left + 80).alias("r"), (24 * F.col("line_idx") + F.col("shift") + 20).alias("b"), (40 + (F.col("doc_id") + 7 * F.col("word_idx")) % 61).cast("int").alias("conf"))


INVOICES = """WITH tot AS (SELECT o_orderkey AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS g, printf('%018d', o_orderkey * 7919 + 13) AS bban FROM orders),
iban AS (SELECT *, g * 19 // 119 AS v, 'DE' || lpad(CAST(CASE WHEN d % 2 = 0 THEN c ELSE (c + 5) % 97 END AS VARCHAR), 2, '0') || bban AS iban FROM (SELECT *, 98 - CAST((bban || '131400')::HUGEINT % 97 AS INT) AS c FROM tot)),
cash AS (SELECT *, ((g - v) // 100)::VARCHAR || ',' || lpad(((g - v) % 100)::VARCHAR, 2, '0') AS net, ((g - v + 100) // 100)::VARCHAR || ',' || lpad(((g - v + 100) % 100)::VARCHAR, 2, '0') AS more,
  (v // 100)::VARCHAR || ',' || lpad((v % 100)::VARCHAR, 2, '0') AS tax, (h // 100)::VARCHAR || ',' || lpad((h % 100)::VARCHAR, 2, '0') AS gross FROM (SELECT *, g + CASE WHEN d % 3 = 0 THEN 1 ELSE 0 END AS h FROM iban)),
wd AS (SELECT d, u.* FROM cash, LATERAL (VALUES (0, 0, 'Rechnungsnr.:', 0), (0, 1, 'R' || d, 0), (0, 2, CASE WHEN d % 5 = 0 THEN 'K7' ELSE 'vom,' END, 0), (0, 3, 'heute', 0),
  (1, 0, 'Netto:', 0), (1, 1, CASE WHEN d % 5 = 0 THEN more END, 15), (1, 2, 'EUR', 0), (1, 3, net, 0), (2, 0, 'MwSt', 0), (2, 1, '19%', 0), (2, 2, CASE WHEN d % 7 <> 0 THEN tax END, 0),
  (3, 0, CASE WHEN d % 7 = 0 THEN 'Summe:' END, 0), (3, 1, 'Gesamt', 0), (3, 2, gross, 0), (4, 0, 'IBAN:', 0), (4, 1, iban[1:4], 0), (4, 2, iban[5:8], 0), (4, 3, iban[9:12], 0), (4, 4, iban[13:16], 0), (4, 5, iban[17:20], 0), (4, 6, iban[21:22], 0),
  (4, 7, 'bei,', 0), (4, 8, 'Bank', 0), (5, 0, 'iban', 0), (5, 1, 'none', 0)) u(line, k, text, shift) WHERE u.text IS NOT NULL),
bx AS (SELECT d, line, k, text, 100 * k AS l, 24 * line + shift AS t, 100 * k + 80 AS r, 24 * line + shift + 20 AS b, CAST(40 + (d + 7 * k) % 61 AS INT) AS conf, regexp_matches(text, '^[0-9]+(,[0-9]{2})?$') AS money FROM wd),
lab AS (SELECT *, CASE lower(rtrim(text, ':.')) WHEN 'netto' THEN 'netto' WHEN 'mwst' THEN 'ust' WHEN 'summe' THEN 'brutto' WHEN 'gesamt' THEN 'brutto' WHEN 'rechnungsnr' THEN 'rechnungsnummer' WHEN 'iban' THEN 'iban' END AS key FROM bx),
cand AS (SELECT a.d, a.key, a.line, a.k AS spot, a.text AS label, c.*, row_number() OVER (PARTITION BY a.d, a.key, a.line, a.k ORDER BY c.k) AS n FROM lab a JOIN bx c ON a.d = c.d AND a.line = c.line AND c.k > a.k AND c.l >= a.r AND 2 * (least(a.b, c.b) - greatest(a.t, c.t)) >= least(a.b - a.t, c.b - c.t)
  WHERE a.key IS NOT NULL AND (a.key IN ('rechnungsnummer', 'iban') OR c.money)),
fit AS (SELECT *, min(CASE WHEN n > 1 AND (NOT regexp_matches(text, '^[A-Za-z0-9]*$') OR size > 34) THEN n END) OVER (PARTITION BY d, key, line, spot) AS stop FROM (SELECT *, sum(length(text)) OVER (PARTITION BY d, key, line, spot ORDER BY n) AS size FROM cand)),
val AS (SELECT d, key, line, spot, any_value(label) AS label, string_agg(text, '' ORDER BY n) AS value, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, min(conf) AS conf FROM fit
  WHERE CASE WHEN key IN ('rechnungsnummer', 'iban') THEN n < coalesce(stop, 100) ELSE n = 1 END GROUP BY d, key, line, spot),
best AS (SELECT *, CASE WHEN key IN ('netto', 'ust', 'brutto') THEN replace(value, ',', '')::BIGINT END AS cents FROM (SELECT *, row_number() OVER (PARTITION BY d, key ORDER BY line, spot) AS n FROM val) WHERE n = 1),
summed AS (SELECT *, max(CASE WHEN key = 'netto' THEN cents END) OVER p + max(CASE WHEN key = 'ust' THEN cents END) OVER p = max(CASE WHEN key = 'brutto' THEN cents END) OVER p AS adds FROM best WINDOW p AS (PARTITION BY d)),
chk AS (SELECT *, CASE WHEN key = 'iban' AND length(value) BETWEEN 15 AND 34 AND regexp_matches(value, '^DE[0-9]+$') THEN (value[5:] || '1314' || value[3:4])::HUGEINT % 97 = 1 ELSE FALSE END AS mod FROM summed)
SELECT d AS doc_id, key, label, value, cents, l::INT AS l, t::INT AS t, r::INT AS r, b::INT AS b, conf, CASE WHEN mod THEN 'iban_mod97_ok' WHEN key IN ('netto', 'ust', 'brutto') AND coalesce(adds, FALSE) THEN 'arithmetic_ok' ELSE '' END AS checks FROM chk"""


@query(INVOICES)
def harvest_by_rules(spark, d):
    """Fields of every invoice by the rules of a profile."""
    found = fields.harvested_by(_invoice_words(spark, d), fields.field_rules(spark, "german_invoice"))
    return found.withColumn("checks", F.array_join("checks", " ")).withColumns({c: F.col(c).cast("int") for c in "ltrb"})


def _readings(spark, d) -> DataFrame:
    """What was said, and how it might have been read: letters taken for others, doubled or dropped."""
    text = F.col("text")
    read = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(text, "lo", "10"), "rn", "m"), "tt", "t"), "([ae])n", "$1$1n")
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("true"), read.alias("read"))


@query(r"""SELECT conv_id, turn, levenshtein(regexp_replace(replace(replace(translate(text, 'lo', '10'), 'rn', 'm'), 'tt', 't'), '([ae])n', '\1\1n', 'g'), text)::BIGINT AS errors, length(text)::BIGINT AS length FROM conversations WHERE text IS NOT NULL""")
def reading_errors(spark, d):
    """Edit distance of every reading, from its edit operations."""
    return alignment.aligned(_readings(spark, d).filter("true is not null"), "conv_id", "turn").select("conv_id", "turn", "errors", "length")


@query_without_sql
def reading_confusions(spark, d):
    """How often each sign was read as another, over all that was said."""
    return alignment.confusions(alignment.aligned(_readings(spark, d), "conv_id", "turn"))


@query("""WITH r AS (SELECT text AS t, translate(text, 'lo', '10') AS a, replace(translate(text, 'l', '1'), 'o', CASE WHEN turn % 2 = 0 THEN '0' ELSE 'o' END) AS b FROM conversations WHERE text IS NOT NULL)
SELECT CASE WHEN a = t AND b = t THEN 'both_right' WHEN b = t THEN 'a_wrong' WHEN a = t THEN 'b_wrong' WHEN a = b THEN 'both_wrong_same' ELSE 'both_wrong_different' END AS bucket, count(*) AS n FROM r GROUP BY 1""")
def reading_verdicts(spark, d):
    """Which of two readers was wrong, and whether alike."""
    said = table(spark, d, "conversations").filter("text is not null")
    second = F.when(F.col("turn") % 2 == 0, F.translate("text", "lo", "10")).otherwise(F.translate("text", "l", "1"))
    own = said.select(F.col("text").alias("true"), F.translate("text", "lo", "10").alias("a"), second.alias("b"))
    return alignment.verdicts(own).groupBy("bucket").agg(F.count("*").alias("n"))


#: Accented letters as single bytes, for an edit distance that counts bytes.
BYTES = "translate({}, 'àâäáãåçéèêëîïíìôöóòõùûüúñßæœÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ012')"


@query(r"""WITH lex AS (SELECT word, count(*) AS weight FROM (SELECT unnest(string_split_regex(lower(text), '[^a-zà-ÿ]+')) AS word FROM benchmark) WHERE length(word) >= 3 GROUP BY word),
tok AS (SELECT conv_id, turn, unnest(range(len(ws))) AS word_idx, unnest(ws) AS token FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations WHERE text IS NOT NULL)),
part AS (SELECT *, regexp_extract(token, '(\p{L}(?:.*\p{L})?)', 1) AS core FROM tok),
unk AS (SELECT DISTINCT lower(core) AS word, CASE WHEN length(core) >= 8 THEN 2 ELSE 1 END AS budget FROM part WHERE NOT regexp_matches(token, '\p{N}') AND length(core) >= 4 AND lower(core) NOT IN (SELECT word FROM lex)),
c AS (SELECT u.word, l.word AS fixed, l.weight, levenshtein(""" + BYTES.format("u.word") + ", " + BYTES.format("l.word") + r""") AS d, budget FROM unk u JOIN lex l ON abs(length(u.word) - length(l.word)) <= budget),
fix AS (SELECT word, fixed, d FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, length(fixed), weight DESC, fixed) AS k FROM c WHERE d <= budget) WHERE k = 1),
put AS (SELECT part.*, d, CASE WHEN upper(core[1]) = core[1] AND lower(core[1]) <> core[1] THEN CASE WHEN length(regexp_replace(core[2:], '\P{L}', '', 'g')) > 0 AND upper(core[2:]) = core[2:] AND lower(core[2:]) <> core[2:] THEN upper(fixed) ELSE upper(fixed[1]) || fixed[2:] END ELSE fixed END AS shown
  FROM part JOIN fix ON lower(core) = word WHERE NOT regexp_matches(token, '\p{N}'))
SELECT conv_id, turn, word_idx, token AS "from", replace(token, core, shown) AS "to", CAST(d AS INT) AS distance FROM put WHERE replace(token, core, shown) <> token""")
def text_corrections(spark, d):
    """Every word of a conversation that a lexicon puts right, as an audit row."""
    split = F.explode(F.split(F.lower("text"), "[^a-zà-ÿ]+")).alias("word")
    lexicon = table(spark, d, "benchmark").select(split).filter("length(word) >= 3").groupBy("word").agg(F.count("*").alias("weight"))
    words = table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("word_idx", "text"))
    return fields.corrections(fields.corrected_words(words, lexicon, long=2))


@query("""WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS, TRUE)::INT AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    """Runs of every user's events with less than six hours between them."""
    return arrivals.sessions(table(spark, d, "events"), "6 hours")
