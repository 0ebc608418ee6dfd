"""Document and raster relations derived from plain tables.

``words``: doc_id line_idx word_idx text l t r b conf leading_space, with boxes
of a monospace page (10 px a character, 24 px a line, y down).
``pixels``: page_id y x v, exploded 8-bit rasters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 16, 12


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Characters, pixels, and rows of plain tables that a task takes apart.
CHARACTERS, PIXELS, ROWS = 4 << 20, 2 << 20, 1 << 18


def _tasks(docs: DataFrame, amount, each: int) -> int:
    """How many partitions deal ``amount`` (an aggregate over ``docs``) with ``each`` in one: as many as the session has at least.

    The number is given to Spark, which would merge partitions by their packed
    size, long before rows are taken apart.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(docs.agg(amount).first()[0] or 0) // each))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` before they are taken apart, so that nothing by that key shuffles what comes of them."""
    return rows.repartition(_tasks(rows, F.count("*"), ROWS), key)


def words(docs: DataFrame) -> DataFrame:
    """Texts are dealt by document before they are taken apart, so that nothing by document or line shuffles again.

    Where ``docs`` does not say how long its texts are (``n_chars``), they are measured.
    """
    n = _tasks(docs, F.sum("n_chars" if "n_chars" in docs.columns else F.length("text")), CHARACTERS)
    lines = docs.filter("text is not null").select("doc_id", "text").repartition(n, "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    tokens = lines.select("doc_id", "line_idx", F.posexplode(F.split("line", " ")).alias("word_idx", "text"))
    before = Window.partitionBy("doc_id", "line_idx").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    size = 10 * F.length("text")
    left = F.coalesce(F.sum(size + 10).over(before), F.lit(0))
    boxed = tokens.withColumn("l", left.cast("int")).filter("text <> ''")
    conf = 40 + (F.col("doc_id") * 31 + F.col("line_idx") * 17 + F.col("word_idx") * 7) % 61
    return boxed.select(
        "doc_id", "line_idx", "word_idx", "text", "l", (24 * F.col("line_idx")).alias("t"), (F.col("l") + size).cast("int").alias("r"),
        (24 * F.col("line_idx") + 20).alias("b"), conf.cast("int").alias("conf"), (F.col("word_idx") > 0).alias("leading_space"),
    )


WORDS_SQL = """
words AS (
  SELECT doc_id, line_idx, word_idx, text, CAST(l AS INT) AS l, CAST(24 * line_idx AS INT) AS t, CAST(l + 10 * length(text) AS INT) AS r,
         CAST(24 * line_idx + 20 AS INT) AS b, CAST(40 + (doc_id * 31 + line_idx * 17 + word_idx * 7) % 61 AS INT) AS conf, word_idx > 0 AS leading_space
  FROM (SELECT *, coalesce(sum(10 * length(text) + 10) OVER (PARTITION BY doc_id, line_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l
        FROM (SELECT doc_id, line_idx, unnest(range(len(ws))) AS word_idx, unnest(ws) AS text
              FROM (SELECT doc_id, line_idx, string_split(line, ' ') AS ws
                    FROM (SELECT doc_id, unnest(range(len(ls))) AS line_idx, unnest(ls) AS line
                          FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)))))
  WHERE text <> '')"""


def _pages(docs: DataFrame) -> DataFrame:
    """``page_id n_chars``, dealt by page before pixels are made, so that nothing by page shuffles pixels."""
    n = _tasks(docs, F.count("*") * (WIDTH * HEIGHT), PIXELS)
    return docs.select(F.col("doc_id").alias("page_id"), "n_chars").repartition(n, "page_id")


def pixels(docs: DataFrame) -> DataFrame:
    spots = _pages(docs).select("page_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y"))
    spots = spots.select("page_id", "n_chars", "y", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x"))
    v = (F.col("x") * F.col("x") * 3 + F.col("y") * 7 + F.col("page_id") * 31 + F.col("n_chars")) % 256
    return spots.select("page_id", "y", "x", v.cast("int").alias("v"))


PIXELS_SQL = f"""
px AS (
  SELECT doc_id AS page_id, CAST(ys.y AS INT) AS y, CAST(xs.x AS INT) AS x,
         CAST((xs.x * xs.x * 3 + ys.y * 7 + doc_id * 31 + n_chars) % 256 AS INT) AS v
  FROM documents, (SELECT unnest(range({HEIGHT})) AS y) ys, (SELECT unnest(range({WIDTH})) AS x) xs)"""


def page_rows(docs: DataFrame) -> DataFrame:
    """``page_id y`` and an array ``v``: the same rasters by rows."""
    spots = _pages(docs).select("page_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y"))
    value = lambda x: ((x * x * 3 + F.col("y") * 7 + F.col("page_id") * 31 + F.col("n_chars")) % 256).cast("int")
    return spots.select("page_id", "y", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), value).alias("v"))
