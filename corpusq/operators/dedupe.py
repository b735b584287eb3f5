"""Documents with equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_duplicates(docs: DataFrame, preferred: str | None = None) -> DataFrame:
    """``(doc, canonical, copies)``: documents whose text equals another's but for white space.

    ``docs(doc, text[, preferred])``; the preferred documents of a group stay, else its smallest id.
    Groups are found by hash with partial aggregation, so a very common text does not meet in a task.
    """
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\s\\x{3000}]+", "")
    d = docs.select("doc", F.sha2(flat, 256).alias("h"), (F.col(preferred) if preferred else F.lit(False)).alias("p")).where(F.length(flat) > 0)
    best = d.groupBy("h").agg(F.min_by("doc", F.struct(~F.col("p"), "doc")).alias("canonical"), F.count("*").alias("copies")).where("copies > 1")
    gone = d.join(best, "h").where("doc <> canonical")
    return gone.where(~F.col("p")).select("doc", "canonical", "copies")
