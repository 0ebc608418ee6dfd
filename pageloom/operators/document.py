"""Document operators over the word relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, tokens


def quality(words: DataFrame, docs: DataFrame, low: int = 75) -> DataFrame:
    """Words, lines, mean confidence, whether it is low, and the union of boxes, by document; null where it has no words."""
    out = words.groupBy("doc_id").agg(
        F.count("*").alias("n_words"), F.countDistinct("line_idx").alias("n_lines"), F.round(F.avg("conf"), 4).alias("mean_conf"),
        F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"),
    )
    out = docs.select("doc_id").join(out, "doc_id", "left")
    return out.fillna(0, ["n_words", "n_lines"]).withColumn("low", F.col("mean_conf") < low)


def lines(words: DataFrame) -> DataFrame:
    """Text and box of each line; words are joined where they have a leading space."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "leading_space", "text"))), lambda w: F.concat(F.when(w["leading_space"], " ").otherwise(""), w["text"]))
    return words.groupBy("doc_id", "line_idx").agg(
        F.array_join(own, "").alias("text"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.min("conf").alias("conf")
    )


def page_text(words: DataFrame) -> DataFrame:
    """Each line and a line break behind it."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: F.concat(x["text"], F.lit("\n")))
    return lines(words).groupBy("doc_id").agg(F.array_join(own, "").alias("page"))


def tsv(words: DataFrame) -> DataFrame:
    """The five levels of the 12-column table: page, block, paragraph, line, word; conf is -1 but for words.

    The first word of a line brings the line's row, the first of a page the
    rows of the levels above, so that one pass over the words makes all rows.
    """
    page, line = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "line_idx")
    ends = (("l", F.min), ("t", F.min), ("r", F.max), ("b", F.max))
    own = words.withColumn("word_num", F.row_number().over(line.orderBy("word_idx"))).withColumn("line_num", F.dense_rank().over(page.orderBy("line_idx")))
    boxes = {"line": F.struct(*(f(c).over(line).alias(c) for c, f in ends)), "page": F.struct(*(f(c).over(page).alias(c) for c, f in ends))}
    own = own.withColumns({f"{k}_box": v for k, v in boxes.items()})

    def level(n, line_num, word_num, box, conf, text):
        return F.struct(
            F.lit(n).alias("level"), F.lit(1).alias("page_num"), F.lit(int(n > 1)).alias("block_num"), F.lit(int(n > 2)).alias("par_num"), line_num.cast("int").alias("line_num"),
            word_num.cast("int").alias("word_num"), box["l"].alias("left"), box["t"].alias("top"), (box["r"] - box["l"]).alias("width"), (box["b"] - box["t"]).alias("height"),
            conf.cast("int").alias("conf"), text.alias("text"),
        )

    nil, none = F.lit(0), F.lit("")
    word = level(5, F.col("line_num"), F.col("word_num"), F.struct("l", "t", "r", "b"), F.col("conf"), F.col("text"))
    of_line = level(4, F.col("line_num"), nil, F.col("line_box"), F.lit(-1), none)
    of_page = [level(n, nil, nil, F.col("page_box"), F.lit(-1), none) for n in (1, 2, 3)]
    first = F.col("word_num") == 1
    out = F.when(first & (F.col("line_num") == 1), F.array(*of_page, of_line, word)).when(first, F.array(of_line, word)).otherwise(F.array(word))
    return own.select("doc_id", F.explode(out).alias("row")).select("doc_id", "row.*")


#: Version and capabilities that a document names, and the resolution, which these pages do not carry.
VERSION, RESOLUTION = "5.5.0", 0
CAPABILITIES = "ocr_page ocr_carea ocr_par ocr_line ocrx_word ocrp_dir ocrp_lang ocrp_wconf"
HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN"
    "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">
<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">
 <head>
  <title>"""
META = f"""</title>
  <meta http-equiv="Content-Type" content="text/html;charset=utf-8"/>
  <meta name='ocr-system' content='tesseract {VERSION}' />
  <meta name='ocr-capabilities' content='{CAPABILITIES}'/>
 </head>
 <body>
  <div class='ocr_page' id='page_1' title='image "\
"""


def hocr(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id hocr``: the XHTML document of each page (doc_id name w h): its block and paragraph, their lines, and the lines' words.

    Words are numbered through the page, and so are lines with a word; boxes
    are clipped to the page.  A page without words has its own element alone.
    The title takes the page's name as it is, the page's element escaped.
    """

    def bbox(l, t, r, b):
        l, t = boxes.clipped(l, F.lit(0), F.col("w")), boxes.clipped(t, F.lit(0), F.col("h"))
        return F.concat(F.lit("bbox "), F.concat_ws(" ", l, t, boxes.clipped(r, l, F.col("w")), boxes.clipped(b, t, F.col("h"))))

    page, ends = ("doc_id", "name", "w", "h"), [f(c).alias(c) for c, f in (("l", F.min), ("t", F.min), ("r", F.max), ("b", F.max))]
    box, number = bbox(*map(F.col, "ltrb")), F.row_number().over(Window.partitionBy("doc_id").orderBy("line_idx", "word_idx"))
    mark = F.concat(
        F.lit("\n      <span class='ocrx_word' id='word_1_"), F.col("number").cast("string"), F.lit("' title='"), box,
        F.lit("; x_wconf "), F.col("conf").cast("int").cast("string"), F.lit("'>"), tokens.markup_escaped(F.col("text")), F.lit("</span>"),
    )
    listed = lambda at, *c: F.array_sort(F.collect_list(F.when(F.col("line_idx").isNotNull(), F.struct(at, *c))))
    own = pages.select(*page).hint("merge").join(words, "doc_id", "left").withColumn("number", number).withColumn("mark", mark)
    own = own.groupBy(*page, "line_idx").agg(F.array_join(F.transform(listed("word_idx", "mark"), lambda x: x["mark"]), "").alias("body"), *ends)
    own = own.groupBy(*page).agg(listed("line_idx", *"ltrb", "body").alias("lines"), *ends)
    line = lambda x, i: F.concat(F.lit("\n     <span class='ocr_line' id='line_1_"), (i + 1).cast("string"), F.lit("' title=\""), bbox(*(x[c] for c in "ltrb")), F.lit('">'), x["body"], F.lit("\n     </span>"))
    block = F.concat(
        F.lit("   <div class='ocr_carea' id='block_1_1' title=\""), box, F.lit("\">\n    <p class='ocr_par' id='par_1_1' title=\""), box, F.lit('">'),
        F.array_join(F.transform("lines", line), ""), F.lit("\n    </p>\n   </div>\n"),
    )
    whole = F.concat(
        F.lit(HEAD), F.col("name"), F.lit(META), tokens.markup_escaped(F.col("name")), F.lit('"; bbox 0 0 '), F.concat_ws(" ", "w", "h"), F.lit(f"; ppageno 0; scan_res {RESOLUTION} {RESOLUTION}'>\n"),
        F.when(F.size("lines") > 0, block).otherwise(""), F.lit("  </div>\n </body>\n</html>\n"),
    )
    return own.select("doc_id", whole.alias("hocr"))


def placed(words: DataFrame, band: int = 240, column: int = 400) -> DataFrame:
    """Words in the block of a grid that holds their box's centre (half-open)."""
    x, y = F.expr("(l + r) div 2"), F.expr("(t + b) div 2")
    return words.groupBy("doc_id", F.floor(y / band).cast("int").alias("block_row"), F.floor(x / column).cast("int").alias("block_col")).agg(F.count("*").alias("n_words"), F.min("conf").alias("conf"))


#: Share of a page's height that its header and its footer take, letters of the longest line there, greatest page number.
BAND, LONGEST, LAST_PAGE = 0.08, 60, 9999


def band(top: Column, bottom: Column, height: Column) -> Column:
    """``header``, ``footer`` or null for a line that lies whole in neither; the header is tried first."""
    extent = F.round(height * BAND).cast("int")
    return F.when((top >= 0) & (bottom <= extent), "header").when((top >= height - extent) & (bottom <= height), "footer")


def furniture(lines: DataFrame, height: int) -> DataFrame:
    """Header and footer lines and the page number, by document with any line.

    A line belongs to a band if it lies whole in it, is short or has the shape
    of a page number, and names no amount.  The number is that of the first
    such line of the footer, or else of the header.
    """
    text = F.trim(F.col("text"))
    own = lines.select("doc_id", "line_idx", band(F.col("t"), F.col("b"), F.lit(height)).alias("band"), text.alias("text"), tokens.page_number(text).alias("number"))
    fits = F.col("band").isNotNull() & ((F.length("text") <= LONGEST) | F.col("number").isNotNull()) & ~tokens.names_amount(F.col("text"))
    own = own.withColumn("band", F.when(fits, F.col("band")))
    listed = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("band") == name, F.col("line_idx")))), lambda i: i.cast("string")), " ")
    counted = fits & (F.col("number") <= LAST_PAGE)
    order = F.struct((F.col("band") == "header").alias("header"), "line_idx")
    pick = lambda c: F.min_by(c, F.when(counted, order))
    return own.groupBy("doc_id").agg(listed("header").alias("header_lines"), listed("footer").alias("footer_lines"), pick("number").alias("page_number"), pick("line_idx").alias("page_number_line"))


def sentences(docs: DataFrame) -> DataFrame:
    """Words, sentence ends and hyphenated line ends of each text; ends within decimals do not count."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", tokens.sentence_ends(text).alias("ends"), F.regexp_count(text, F.lit(r"\p{L}-\n")).alias("wraps"))


def trend(words: DataFrame, gate: float = 0.5) -> DataFrame:
    """Slope and fit of word width over the line's height on the page; whether the fit passes the gate.

    Sums are whole numbers, so that equal pages have equal values in whatever
    order their words come; 1e-10 lifts a value halfway between two decimals.
    A page of words of one width fits wholly.
    """
    x, y = F.col("t").cast("long"), (F.col("r") - F.col("l")).cast("long")
    own = words.groupBy("doc_id").agg(*(F.sum(v).cast("decimal(20,0)").alias(c) for v, c in ((F.lit(1), "n"), (x, "x"), (y, "y"), (x * x, "xx"), (x * y, "xy"), (y * y, "yy"))))
    spread = lambda a, b: (F.col("n") * F.col(a + b) - F.col(a) * F.col(b)).cast("double").alias(a + b)
    own = own.select("doc_id", spread("x", "x"), spread("x", "y"), spread("y", "y")).filter("xx > 0")
    slope = F.col("xy") / F.col("xx")
    fit = F.when(F.col("yy") == 0, 1.0).otherwise(slope * (F.col("xy") / F.nullif("yy", F.lit(0.0))))
    return own.select("doc_id", F.round(slope + 1e-10, 6).alias("slope"), F.round(fit + 1e-10, 6).alias("fit"), (fit >= gate).alias("significant"))


def font_sizes(words: DataFrame, least: int = 10) -> DataFrame:
    """Median word width of each line; a line of few words takes the median of the page's well-filled lines."""
    own = words.groupBy("doc_id", "line_idx").agg(F.count("*").alias("n"), F.median(F.col("r") - F.col("l")).alias("size"))
    well = own.filter(F.col("n") >= least).groupBy("doc_id").agg(F.median("size").alias("well"))
    size = F.when(F.col("n") >= least, F.col("size")).otherwise(F.coalesce("well", "size"))
    return own.join(well, "doc_id", "left").select("doc_id", "line_idx", "n", F.round(size, 4).alias("size"))


def assembled(lines: DataFrame) -> DataFrame:
    """``doc_id sent_idx text``: sentences across lines.

    A hyphen behind a letter at a line's end goes and joins the line with the
    next, any other line end is a blank; a sentence ends with a run of ``.!?``
    before white space or the page's end.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"])
    page = lines.groupBy("doc_id").agg(F.concat(F.array_join(listed, "\n"), F.lit("\n")).alias("text"))
    joined = F.replace(F.regexp_replace("text", r"(\p{L})-\n", "$1"), F.lit("\n"), F.lit(" "))
    parts = F.filter(F.transform(F.split(joined, r"(?<=[.!?])[ \t\r\f]+"), lambda s: F.trim(s)), lambda s: s != "")
    return page.select("doc_id", F.posexplode(parts).alias("sent_idx", "text"))


def json_lines(lines: DataFrame) -> DataFrame:
    """The page's box and its lines as JSON, in order."""
    mark = F.concat(F.lit('{"text":"'), boxes.json_text(F.col("text")), F.lit('","bbox":'), boxes.json_box(F.struct("l", "t", "r", "b")), F.lit("}"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", mark.alias("mark")))), lambda x: x["mark"])
    whole = F.struct(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))
    return lines.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_lines"), boxes.json_box(whole).alias("box"), F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("lines_json"))
