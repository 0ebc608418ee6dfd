"""Tables that a loop leaves for its next round, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the folder that ``spark.checkpoint.dir`` names; only where it is unset, on one machine, in a temporary one.

    This cuts the lineage: a lost executor costs one round.  The files are
    packed many times smaller than their rows, so that Spark, which goes by
    files, would have the driver gather them for a broadcast; joins with a kept
    table are merges instead.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="pageloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/pageloom-rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


#: Spark's setting by which a join asks both sides to be dealt by all of its keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def dealt_once(spark):
    """Joins within take tables that are dealt by some of their keys alike, such as the page, as they lie."""
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


def dropped(*tables: DataFrame) -> None:
    """Delete tables from ``kept`` that nothing will read any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            own = context._jvm.org.apache.hadoop.fs.Path(path)
            if own.getParent().getName() == "pageloom-rounds":
                own.getFileSystem(context._jsc.hadoopConfiguration()).delete(own, True)
