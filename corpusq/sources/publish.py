"""Publishing: block tables, versions with checks, Q&A index."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusq.operators.blocks import with_offsets
from corpusq.sources.storage import deleted, listed


def publish_blocks(blocks: DataFrame, path: str, partitions: int = 8) -> None:
    """Write blocks that are not blank in document and place order, with their offsets."""
    d = with_offsets(blocks.where("trim(text) <> ''").withColumn("len", F.length("text")))
    d.repartitionByRange(partitions, "doc").sortWithinPartitions("doc", "ord").write.mode("overwrite").parquet(path)


def _described(table: DataFrame, name: str) -> DataFrame:
    """``(name, rows, checksum, schema)`` of a table, whatever its order; one row."""
    checksum = F.coalesce(F.sum(F.shiftrightunsigned(F.xxhash64(*(F.to_json(F.struct(c)) for c in table.columns)), 8).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return table.agg(F.count("*").alias("rows"), checksum.alias("checksum")).select(F.lit(name).alias("name"), "rows", "checksum", F.lit(table.schema.json()).alias("schema"))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that were published whole: those with a committed manifest."""
    made = [n for n in listed(spark, f"{folder}/manifests") if n.startswith("v=")]
    return sorted(int(n[2:]) for n in made if "_SUCCESS" in listed(spark, f"{folder}/manifests/{n}"))


def current_version(spark: SparkSession, folder: str) -> int:
    """The latest published version."""
    made = versions(spark, folder)
    if not made:
        raise FileNotFoundError(folder)
    return made[-1]


def publish_version(spark: SparkSession, tables: dict[str, DataFrame], folder: str, checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame]]) -> int:
    """Write all tables as the next version, and its manifest last, if no check finds a violation.

    A version is what its manifest says: rows, checksum and schema of every table, taken from the
    tables as they were read back. Without a committed manifest there is no version, so a run that dies
    anywhere leaves the one before current. What such runs left is removed here, and so is a version
    that fails a check; the error names the check.
    """
    made = versions(spark, folder)
    version = max(made, default=0) + 1
    for kind in (folder, f"{folder}/manifests"):
        for name in listed(spark, kind):
            if name.startswith("v=") and int(name[2:]) not in made:
                deleted(spark, f"{kind}/{name}")
    try:
        for name, table in tables.items():
            table.write.parquet(f"{folder}/v={version}/{name}")
        written = {name: spark.read.schema(table.schema).parquet(f"{folder}/v={version}/{name}") for name, table in tables.items()}
        for name, check in checks.items():
            if not check(written).isEmpty():
                raise ValueError(f"check {name} failed for version {version}")
        described = [_described(table, name) for name, table in written.items()]
        manifest = described[0]
        for d in described[1:]:
            manifest = manifest.unionByName(d)
        manifest.coalesce(1).write.parquet(f"{folder}/manifests/v={version}")
    except BaseException:
        deleted(spark, f"{folder}/manifests/v={version}")
        deleted(spark, f"{folder}/v={version}")
        raise
    return version


def read_version(spark: SparkSession, folder: str, version: int | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a version, the current one by default, under the schemas of its manifest.

    The reader stays with the version that it found, whatever is published meanwhile. With ``verify`` a
    table whose rows or checksum are not those of the manifest is an error.
    """
    version = current_version(spark, folder) if version is None else version
    out = {}
    for r in spark.read.parquet(f"{folder}/manifests/v={version}").collect():  # a row for each table
        table = spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(f"{folder}/v={version}/{r.name}")
        if verify and (found := _described(table, r.name).first()) != r:
            raise ValueError(f"table {r.name} of version {version} is torn: {found.rows} rows of {r.rows}")
        out[r.name] = table
    return out


def publish_qa_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def qa_index_is_current(spark: SparkSession, path: str, recomputed: DataFrame) -> bool:
    """Whether the published index holds just the recomputed rows."""
    old = spark.read.parquet(path).select(*recomputed.columns)
    return not old.exceptAll(recomputed).limit(1).count() and not recomputed.exceptAll(old).limit(1).count()
