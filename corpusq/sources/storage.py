"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir() and sc.master.startswith("local"):
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-corpusq-"))
    if not sc.getCheckpointDir():
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as ``checkpointed``, compressed, for tables with texts: a checkpoint holds them as they are."""
    folder = new_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder beside the checkpoints that nothing has used."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a curated table that every task may hold.
MOST_CURATED = 10_000


def bounded(table: DataFrame, what: str, most: int = MOST_CURATED) -> DataFrame:
    """``table`` marked for broadcast, after its rows are counted up to the bound; a larger one is an error."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"{what}: over {most} rows, too many to compare with every row of a table")
    return F.broadcast(table)
