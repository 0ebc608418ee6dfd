"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see.

    ``spark.checkpoint.dir`` names it; only a session without that setting
    (a single-machine test) gets a temporary folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pageloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage, so that a lost executor costs one stage, and gives the
    optimizer the true size of what follows.  The shuffle files of the query
    behind ``df`` are removed with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pageloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables from ``written`` that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            own = jvm.org.apache.hadoop.fs.Path(path)
            if own.getParent().toString().endswith("/pageloom"):
                own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """0 to 4; rows of fold 0 are held out of every fit."""
    return F.crc32(doc_id.cast("string")) % 5


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), with the columns in ``keep``."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes at most, or one row."""
    sizes = batch.column(column).nbytes
    if sizes <= limit or batch.num_rows <= 1:
        yield batch
        return
    from pyarrow import compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def pieces_of_lists(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of ``batch`` whose list ``column`` holds about ``limit`` elements at most, or one row."""
    from pyarrow import compute as pc

    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_pylist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def coded(lists: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of all lists, each word's index among them, and the lists' lengths."""
    distinct = list(set().union(*lists))
    order = {w: i for i, w in enumerate(distinct)}
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return distinct, np.fromiter((order[w] for own in lists for w in own), np.int64, int(lengths.sum())), lengths


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run of ``lengths`` rows of ``values``; an empty run gives zeros."""
    out = np.zeros((len(lengths), *values.shape[1:]))
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full], axis=0)
    return out


#: Characters of the longest text that a classifier learns from.
LONGEST = 50_000


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: dict[int, int], extra: tuple = ()) -> list:
    """A bounded sample to learn from: at most ``per_class[c]`` documents of class ``c``, in the order of their ids' hash.

    Fold 0 is left out.  A document with several labels has their majority (a
    tie counts as 1).  Texts of more than ``LONGEST`` characters are not learned
    from; the others are learned from whole.  ``weight`` is the number of labelled documents that a row stands for, so that weighted
    rows have the classes' true shares.
    """
    own = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    own = own.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    total = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    picked = None
    for c, n in per_class.items():
        part = own.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        part = part.withColumn("weight", F.lit(max(1.0, total.get(c, 0) / n)))
        picked = part if picked is None else picked.unionByName(part)
    picked = written(picked, "sample")
    rows = docs.filter(F.col("text").isNotNull() & (F.length("text") <= LONGEST)).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", "weight", *extra)
    return sorted(rows.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])


def extended(docs: DataFrame, **kinds: str) -> tuple[DataFrame, T.StructType]:
    """``docs`` without columns that ``kinds`` names, and its schema with them."""
    own = docs.drop(*kinds)
    fields = T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in kinds.items())).fields
    return own, T.StructType([*own.schema.fields, *fields])
