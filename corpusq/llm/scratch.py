"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may go without one: it then gets a new temporary folder, kept in the
    session for later calls. On a cluster a missing setting is an error, since executors would
    not see each other's files.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("corpusq.shared.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-corpusq-")
        spark.conf.set("corpusq.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/corpusq-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; lost executors cannot lose it."""
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Remove the files of a ``materialize`` result that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
