"""Checks of published tables; each returns the rows that violate it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions import text as tx


def blocks_against_offsets(blocks: DataFrame, offsets: DataFrame) -> DataFrame:
    """Blocks and offsets that disagree in identity, start or length."""
    a, b = blocks.select("doc", "ord", "start", "len"), offsets.select("doc", "ord", F.col("start").alias("start_b"), F.col("len").alias("len_b"))
    return a.join(b, ["doc", "ord"], "full").where(~F.col("start").eqNullSafe(F.col("start_b")) | ~F.col("len").eqNullSafe(F.col("len_b")))


def left_markup(blocks: DataFrame) -> DataFrame:
    return blocks.where(tx.has_markup(F.col("text"))).select("doc", "ord")


def wrong_language(blocks: DataFrame, main: str) -> DataFrame:
    """Blocks of the main language in a table of foreign ones."""
    return blocks.where(F.col("lang") == main).select("doc", "ord")


def excluded_but_there(blocks: DataFrame, exclusions: DataFrame) -> DataFrame:
    return blocks.join(exclusions.select("doc").distinct(), "doc", "left_semi").select("doc", "ord")


def without_location(located: DataFrame) -> DataFrame:
    return located.where("path is null or path = ''").select("doc", "ord")


def broken_jumps(jumps: DataFrame, chapters: DataFrame) -> DataFrame:
    """Jumps to a chapter that does not exist, lies in another document, or has fewer sections."""
    c = chapters.select("key", F.col("doc").alias("_doc"), F.col("sections").alias("_sections"))
    d = jumps.join(c, "key", "left")
    return d.where("_doc is null or _doc <> doc or section < 0 or section >= _sections").select(*jumps.columns)


def outside_corpus(offsets: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Offsets of unknown documents or beyond the corpus."""
    known = docs.select("doc").distinct().withColumn("_k", F.lit(True))
    return offsets.join(known, "doc", "left").where(F.col("_k").isNull() | (F.col("start") < 0) | (F.col("start") + F.col("len") > length)).drop("_k")


def repeated_footprints(chapters: DataFrame) -> DataFrame:
    """Chapters that share a document and range with another, or whose range is empty."""
    same = chapters.groupBy("doc", "start", "end").agg(F.count("*").alias("n"))
    return same.where("n > 1 or (end is not null and end <= start)")


def wrong_chapter_count(chapters: DataFrame, expected: DataFrame) -> DataFrame:
    """Routes whose number of chapters is not the expected one."""
    n = chapters.groupBy("work", "route").agg(F.count("*").alias("n"))
    return expected.join(n, ["work", "route"], "left").where(~F.col("n").eqNullSafe(F.col("expected")))


def baseline_differs(blocks: DataFrame, baseline: int) -> DataFrame:
    """The joined length of all blocks, where it is not the baseline."""
    return blocks.agg((F.sum(F.col("len") + 1) - 1).alias("length")).where(F.col("length") != baseline)


def duplicated_partition(recovered: DataFrame, remaining: DataFrame) -> DataFrame:
    """Blocks that stand in both parts, or twice in one."""
    both = recovered.select("doc", "ord").unionAll(remaining.select("doc", "ord"))
    return both.groupBy("doc", "ord").agg(F.count("*").alias("n")).where("n > 1")
