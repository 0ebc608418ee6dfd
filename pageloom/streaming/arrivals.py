"""Files as they arrive, each content once; and sessions of events, the same rows in batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*", at_once: int = 100, streaming: bool = True) -> DataFrame:
    """Files of a folder that any store Spark reads may hold: ``path modificationTime length content``, at most ``at_once`` new ones in a batch.

    What a query has taken in is in its checkpoint, so that a restart takes
    no file twice; the limit is the back-pressure.  Spark lists no empty files.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(FILE).format("binaryFile").option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", at_once) if streaming else reader).load(folder)


def once(files: DataFrame, within: str = "1 day") -> DataFrame:
    """``files`` with ``sha256``, each content once, whatever its name.

    A stream forgets a content when the watermark has passed it by ``within``;
    a batch keeps the oldest file of a content, by time and then by path.
    """
    keyed = files.withColumn("sha256", F.sha2("content", 256))
    if files.isStreaming:
        return keyed.withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["sha256"])
    first = keyed.groupBy("sha256").agg(F.min(F.struct("modificationTime", "path")).alias("f")).select("sha256", F.col("f.path").alias("path"))
    return keyed.join(first, ["sha256", "path"], "left_semi").select(*files.columns, "sha256")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``user_id start end n total`` of runs of a user's events (ts user_id value) that lie less than ``gap`` apart.

    ``end`` is the last event's time.  With a stream, a session leaves once
    the watermark has passed its last event by the gap.
    """
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    own = events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    own = own.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return own.select("user_id", "start", "end", "n", "total")
