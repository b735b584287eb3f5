"""Numbering of rows without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of one range; a task orders the rows of a range, not those of a key.
RANGE = 4096


def doc_range(doc: str = "doc") -> Column:
    return F.floor(F.col(doc) / RANGE)


def numbered(rows: DataFrame, keys: list[str], major: list[str], minor: list[str], name: str, doc: str = "doc") -> DataFrame:
    """``rows`` with ``name``: their number inside ``keys`` by ``major``, then ``minor``, which begins with ``doc``.

    Rows are numbered inside ranges of documents, and every range is shifted by the sizes of those
    before it, so a key with very many rows is split over tasks.
    """
    d = rows.withColumn("_part", doc_range(doc))
    at = [*keys, *major, "_part"]
    sizes = d.groupBy(*at).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(*major, "_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = d.withColumn("_n", F.row_number().over(Window.partitionBy(*at).orderBy(*minor)))
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in at]
    both = inside.alias("i").join(shift.alias("s"), same)
    return both.select(*(F.col(f"i.{c}").alias(c) for c in rows.columns), (F.col("i._n") + F.col("s._shift")).alias(name))
