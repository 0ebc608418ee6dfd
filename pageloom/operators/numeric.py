"""Numeric operators on vectors: quantization, softmax, top-k, inner products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exploded(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.posexplode("embedding").alias("i", "p"))


def quantized(vectors: DataFrame) -> DataFrame:
    """Components times 127, rounded half away from zero and clamped."""
    q = F.greatest(F.lit(-127), F.least(F.lit(127), F.round(F.col("p").cast("double") * 127).cast("int")))
    return exploded(vectors).select("vec_id", "i", q.alias("q"))


def top_outputs(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` largest quantized components; ties to the smaller index."""
    order = Window.partitionBy("vec_id").orderBy(F.desc("q"), "i")
    return quantized(vectors).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def softmax(vectors: DataFrame) -> DataFrame:
    """Softmax, shifted by the maximum: the largest probability and the entropy of the components."""
    whole = Window.partitionBy("vec_id")
    e = F.exp(F.greatest(F.col("p").cast("double") - F.max(F.col("p").cast("double")).over(whole), F.lit(-86.0)))
    own = exploded(vectors).withColumn("e", e).withColumn("s", F.col("e") / F.sum("e").over(whole))
    return own.groupBy("vec_id").agg(F.round(F.max("s"), 8).alias("top"), F.round(-F.sum(F.col("s") * F.log("s")), 6).alias("entropy"))


def products(vectors: DataFrame, every: int = 64) -> DataFrame:
    """Quantized inner products of each vector with fixed weights w(row, i) = (7 row + 3 i) mod 11 - 5."""
    rows = quantized(vectors).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(3))))
    w = (7 * F.col("row") + 3 * F.col("i")) % 11 - 5
    return rows.groupBy("vec_id", "row").agg(F.sum(w * F.col("q")).alias("product"))
