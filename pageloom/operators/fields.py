"""Fields harvested from invoices, and correction against a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, tokens

# Labels and the field each stands for.
LABELS = {"netto": "net", "ust": "vat", "mwst": "vat", "brutto": "gross", "gesamt": "gross"}


def harvested(words: DataFrame) -> DataFrame:
    """``doc_id key label value cents``: the nearest amount to the right of a label in its line; the first label in page order wins."""
    rules = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    order = Window.partitionBy("doc_id", "line_idx").orderBy("word_idx")
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    cents = tokens.amount_cents(F.col("text"))
    own = words.withColumn("cents", cents).withColumn("amount", F.when(F.col("cents").isNotNull(), F.struct("text", "cents")))
    own = own.withColumn("next", F.first("amount", ignorenulls=True).over(ahead)).withColumn("key", rules[tokens.label(F.col("text"))])
    first = Window.partitionBy("doc_id", "key").orderBy("line_idx", "word_idx")
    own = own.filter("key is not null and next is not null").withColumn("n", F.row_number().over(first)).filter("n = 1")
    return own.select("doc_id", "key", F.col("text").alias("label"), F.col("next.text").alias("value"), F.col("next.cents").alias("cents"))


def checked(fields: DataFrame) -> DataFrame:
    """Net, tax and gross of each document, and whether they add up."""
    out = fields.groupBy("doc_id").agg(*(F.max(F.when(F.col("key") == k, F.col("cents"))).alias(k) for k in ("net", "vat", "gross")))
    return out.withColumn("sums", F.coalesce(F.col("net") + F.col("vat") == F.col("gross"), F.lit(False)))


# The fields of an invoice, each with its kind and its labels.
INVOICE = {
    "netto": ("amount", "netto nettobetrag zwischensumme"),
    "ust": ("amount", "ust ust. mwst mwst. umsatzsteuer mehrwertsteuer"),
    "brutto": ("amount", "brutto bruttobetrag gesamt gesamtbetrag summe endbetrag total"),
    "rechnungsnummer": ("id", "rechnungsnr rechnungsnr. rechnungsnummer rechnung-nr re-nr re-nr."),
    "steuernummer": ("id", "steuernr steuernr. steuernummer st-nr st-nr. ust-idnr ust-idnr. ust-id"),
    "iban": ("id", "iban"),
}
#: Fixed value: longest id that is put together from several words, as an IBAN is printed in groups.
LONGEST_ID = 34


def field_rules(spark: SparkSession, profile: str | None) -> DataFrame | None:
    """Rules ``key kind label`` of a profile by name, one row a label; None without a name, and an error for one that is unknown."""
    if not profile:
        return None
    if profile != "german_invoice":
        raise ValueError(f"unknown profile of fields: {profile}")
    return spark.createDataFrame([(key, kind, label) for key, (kind, labels) in INVOICE.items() for label in labels.split()], "key string, kind string, label string")


def value_text(words: DataFrame) -> Column:
    """A word as its number was read, where it has one."""
    return F.coalesce("numeric_norm", "text") if "numeric_norm" in words.columns else F.col("text")


def _joined_id(found: Column) -> Column:
    """An id from its words (value l t r b conf), in order: the first, and those behind it while they are letters and digits and there is room."""
    state = F.struct(found[0]["value"].alias("value"), *(found[0][c].alias(c) for c in "ltrb"), found[0]["conf"].alias("conf"), F.lit(True).alias("open"))

    def step(a, w):
        room = a["open"] & w["value"].rlike("^[A-Za-z0-9]*$") & (F.octet_length(a["value"]) + F.octet_length(w["value"]) <= LONGEST_ID)
        grown = F.struct(F.concat(a["value"], w["value"]).alias("value"), *(f(a[c], w[c]).alias(c) for f, c in ((F.least, "l"), (F.least, "t"), (F.greatest, "r"), (F.greatest, "b"))), F.least(a["conf"], w["conf"]).alias("conf"), F.lit(True).alias("open"))
        shut = F.struct(a["value"].alias("value"), *(a[c].alias(c) for c in "ltrb"), a["conf"].alias("conf"), F.lit(False).alias("open"))
        return F.when(room, grown).otherwise(shut)

    return F.aggregate(F.slice(found, 2, LONGEST_ID), state, step)


def harvested_by(words: DataFrame, rules: DataFrame) -> DataFrame:
    """``doc_id key label value cents l t r b conf checks``: the fields that ``rules`` (key kind label) find among words.

    A label's value lies to its right, in its line and in its band: the
    nearest amount, or the nearest word with those that continue it.  The
    first label in page order that has a value wins.  A line's words are brought
    together once; words dealt by doc_id are not shuffled at all.  ``checks``: an IBAN's
    own digits, and whether net and tax make up the gross amount.
    """
    named = rules.groupBy("label").agg(F.collect_list(F.struct("key", "kind")).alias("rules"))
    own = words.filter("doc_id is not null and line_idx is not null").withColumn("value", value_text(words)).withColumn("label", tokens.label(F.col("text"))).join(F.broadcast(named), "label", "left")
    place = lambda w: boxes.box(*(w[c] for c in "ltrb"))
    word = F.struct("word_idx", "value", *"ltrb", "conf", tokens.amount_cents(F.col("value")).alias("cents"))
    named = F.struct("word_idx", "text", F.struct(*"ltrb").alias("box"), "rules")
    lines = own.groupBy("doc_id", "line_idx").agg(F.array_sort(F.collect_list(word)).alias("words"), F.collect_list(F.when(F.col("rules").isNotNull(), named)).alias("labels"))
    found = lines.select("doc_id", "line_idx", "words", F.explode("labels").alias("at")).select("doc_id", "line_idx", F.col("at.word_idx").alias("label_idx"), F.col("at.text").alias("label"), F.col("at.box").alias("label_box"), "words", F.inline("at.rules"))
    is_id = F.col("kind") == "id"
    fits = lambda w: (w["word_idx"] > F.col("label_idx")) & (w["l"] >= F.col("label_box.r")) & boxes.same_band(F.col("label_box"), place(w)) & (is_id | w["cents"].isNotNull())
    found = found.withColumn("found", F.slice(F.filter("words", fits), F.lit(1), F.when(is_id, LONGEST_ID + 1).otherwise(1))).drop("words").filter(F.size("found") > 0)
    found = found.withColumn("id", F.when(is_id, _joined_id(F.col("found"))))
    first = Window.partitionBy("doc_id", "key").orderBy("line_idx", "label_idx")
    found = found.withColumn("n", F.row_number().over(first)).filter("n = 1")
    pick = lambda c: F.when(is_id, F.col(f"id.{c}")).otherwise(F.col("found")[0][c]).alias(c)
    out = found.select("doc_id", "key", "label", pick("value"), F.when(~is_id, F.col("found")[0]["cents"]).alias("cents"), *(pick(c) for c in "ltrb"), pick("conf"))
    page = Window.partitionBy("doc_id")
    part = {k: F.max(F.when(F.col("key") == k, F.col("cents"))).over(page) for k in ("netto", "ust", "brutto")}
    adds_up = F.col("key").isin(*part) & F.coalesce(part["netto"] + part["ust"] == part["brutto"], F.lit(False))
    checks = F.array(F.when(F.col("cents").isNull() & tokens.iban_valid(F.col("value")), "iban_mod97_ok"), F.when(adds_up, "arithmetic_ok"))
    return out.withColumn("checks", F.array_compact(checks))


def _cuts(word: Column, times: int) -> Column:
    """The strings that are left of a word without up to ``times`` of its letters."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = F.array(word)
    for _ in range(times):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, once))))
    return out


def corrected(unknown: DataFrame, lexicon: DataFrame, least: int = 4, short: int = 1, long: int = 1, long_from: int = 8) -> DataFrame:
    """``word fixed distance`` of words that few edits turn into a known word: ``short``, or ``long`` from a length of ``long_from``.

    ``unknown``: word; ``lexicon``: word weight.  Ties: distance, shorter, more
    frequent, earlier in the alphabet.  Words meet under the strings that
    remain when as many letters are deleted, so that no pair is compared
    without one such string in common.
    """
    budget, most = boxes.edits_allowed(F.length("word"), short, long, long_from), max(short, long)
    reduced = lambda df, n: df.withColumn("cut", F.explode(_cuts(F.col("word"), n)))
    known = lexicon.filter(F.length("word") >= least - most)
    open_ = unknown.filter(F.length("word") >= least).select("word").distinct().join(lexicon, "word", "left_anti").withColumn("budget", budget)
    left = None
    for n in sorted({short, long}):
        part = reduced(open_.filter(F.col("budget") == n), n)
        left = part if left is None else left.unionByName(part)
    right = reduced(known, most).select(F.col("word").alias("fixed"), "weight", "cut")
    pairs = left.join(right, "cut").filter(F.abs(F.length("word") - F.length("fixed")) <= F.col("budget")).select("word", "fixed", "weight", "budget").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("word", "fixed", most)).filter((F.col("distance") >= 0) & (F.col("distance") <= F.col("budget")))
    best = F.min_by(F.struct("fixed", "distance"), F.struct("distance", F.length("fixed"), -F.col("weight"), "fixed"))
    return pairs.groupBy("word").agg(best.alias("b")).select("word", "b.fixed", "b.distance")


def corrected_words(words: DataFrame, lexicon: DataFrame, least: int = 4, short: int = 1, long: int = 1, long_from: int = 8) -> DataFrame:
    """``words`` with ``fixed`` and ``distance``: the text put right, or as it is, and null.

    Signs around a word and its capitals stay.  A token with a digit is data
    and never touched, nor is a known word.  Each distinct word is looked up once.
    """
    own = words.withColumn("core", F.when(~F.col("text").rlike(r"\p{N}"), F.lower(boxes.core(F.col("text"))["core"])))
    found = corrected(own.filter("core is not null").select(F.col("core").alias("word")), lexicon, least, short, long, long_from)
    part = boxes.core(F.col("text"))
    own = own.join(found.withColumnRenamed("word", "core").withColumnRenamed("fixed", "known"), "core", "left")
    put = F.concat(part["prefix"], boxes.cased_like(part["core"], F.col("known")), part["suffix"])
    return own.withColumn("fixed", F.when(F.col("known").isNotNull(), put).otherwise(F.col("text"))).drop("core", "known")


def corrections(fixed_words: DataFrame) -> DataFrame:
    """The audit rows of ``corrected_words``: every word that was changed."""
    return fixed_words.filter("distance is not null and fixed <> text").withColumnRenamed("text", "from").withColumnRenamed("fixed", "to")
