"""Names by what stands inside them: a range-partitioned table of all suffixes.

A query stands inside a name where a suffix of the name begins with it. All suffixes of all names lie
in ranges of their order, and a query looks up the ranges that hold suffixes beginning with it, each
by binary search. Equal suffixes are ordered by their names, so a frequent ending is split too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.sources.storage import checkpointed

#: Suffixes of one range, about; stands after every character.
RANGE, LAST = 1 << 17, "\U0010ffff"


def suffix_table(names: DataFrame) -> DataFrame:
    """``(range, suffix, name, at, word)`` of ``names(name)``: every suffix without regard to case, whether a Latin word may begin there, by range.

    Names are taken once each; a null or empty name has no suffix. For names, not texts: the suffixes of
    one take up the square of its length.
    """
    low = F.lower("name")
    each = names.select("name").where("name <> ''").distinct().select("name", low.alias("low"), F.explode(F.sequence(F.lit(0), F.length(low) - 1)).alias("at"))
    begins = (F.col("at") == 0) | ~F.expr("substring(low, at, 1)").rlike("^[a-z0-9]$")
    d = each.select(F.expr("substring(low, at + 1)").alias("suffix"), "name", "at", begins.alias("word"))
    ranges = max(1, -(-d.count() // RANGE))
    return checkpointed(d.repartitionByRange(ranges, "suffix", "name").withColumn("range", F.spark_partition_id()))


def _in_ranges(queries: DataFrame, table: DataFrame) -> DataFrame:
    """``(query_id, low, latin, range)``: queries with all ranges that may hold suffixes beginning with them.

    The least suffix of every range reaches the driver, one of about RANGE suffixes.
    """
    firsts = table.groupBy("range").agg(F.min("suffix").alias("first")).orderBy("first", "range").collect()
    heads, numbers = [r.first for r in firsts], [r.range for r in firsts]
    held = queries.sparkSession.sparkContext.broadcast((np.array([h.encode() for h in heads], object), np.array(numbers, np.int32)))
    schema = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = held.value
        for batch in batches:
            low = [q.encode() for q in batch.column(1).to_pylist()]
            a = [max(0, int(np.searchsorted(first, q, "left")) - 1) for q in low]
            b = [int(np.searchsorted(first, q + LAST.encode(), "right")) for q in low]
            row = np.repeat(np.arange(len(low)), [y - x for x, y in zip(a, b)])
            ranges = number[np.concatenate([np.arange(x, y) for x, y in zip(a, b)])] if len(row) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(ranges, pa.int32())], ["query_id", "low", "latin", "range"])

    if not firsts:
        return queries.select("query_id", F.lower("q").alias("low"), F.lit(False).alias("latin"), F.lit(0).alias("range")).limit(0)
    return queries.where("q <> ''").select("query_id", F.lower("q").alias("low"), tx.is_latin(F.col("q")).alias("latin")).mapInArrow(run, f"query_id {schema}, low string, latin boolean, range int")


def _looked_up(asked: pa.Table, suffixes: pa.Table) -> pa.Table:
    """Places of the asked queries among the suffixes of one range."""
    text = np.array([s.encode() for s in suffixes.column("suffix").to_pylist()], object)
    order = np.argsort(text, kind="stable")
    text = text[order]
    word = suffixes.column("word").to_numpy(zero_copy_only=False)[order]
    low = [q.encode() for q in asked.column("low").to_pylist()]
    a, b = np.searchsorted(text, low, "left") if low else [], np.searchsorted(text, [q + LAST.encode() for q in low], "right") if low else []
    rows, places = [], []
    for i, latin in enumerate(asked.column("latin").to_pylist()):
        at = np.arange(a[i], b[i])
        at = at[word[at]] if latin else at
        rows.append(np.full(len(at), i))
        places.append(order[at])
    row = pa.array(np.concatenate(rows) if rows else np.zeros(0, int))
    place = pa.array(np.concatenate(places) if places else np.zeros(0, int))
    found = suffixes.take(place)
    return pa.table({"query_id": asked.column("query_id").take(row), "name": found.column("name"), "at": found.column("at")})


def names_with(queries: DataFrame, names: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """``(query_id, name, at)``: names that hold ``queries(query_id, q)``, and where first.

    Anywhere without regard to case; a query with Latin letters and no Chinese or Japanese ones only
    where a word begins. ``table`` is a kept ``suffix_table`` of the names. Null and empty queries hold
    nowhere.
    """
    table = suffix_table(names) if table is None else table
    asked = _in_ranges(queries.select("query_id", "q"), table)
    kind = queries.schema["query_id"].dataType.simpleString()
    found = asked.groupBy("range").cogroup(table.groupBy("range")).applyInArrow(_looked_up, f"query_id {kind}, name string, at int")
    return found.groupBy("query_id", "name").agg(F.min("at").alias("at"))
