"""Blocks of documents: cutting, offsets, tables of contents, language runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import lang as lg
from corpusq.functions import text as tx


def blocks_from_documents(documents: DataFrame) -> DataFrame:
    """``(doc, ord, text, len)``: the lines of every document that are not empty, in place order."""
    d = documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    return d.where("text <> ''").withColumn("len", F.length("text"))


def load_blocks(corpus: DataFrame, offsets: DataFrame) -> DataFrame:
    """Cut ``corpus(part, text)`` by ``offsets(part, start, length, doc, ord)``; starts count from 0."""
    return offsets.join(corpus, "part").select("doc", "ord", F.substring("text", F.col("start") + 1, F.col("length")).alias("text"))


def split_paragraphs(documents: DataFrame) -> DataFrame:
    """``(doc, ord, text)``: paragraphs between blank lines, trimmed, without empty ones."""
    parts = F.filter(F.transform(F.split("text", "\\n\\s*\\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return documents.select(F.col("doc_id").alias("doc"), F.posexplode(parts).alias("ord", "text"))


def with_offsets(blocks: DataFrame) -> DataFrame:
    """Blocks with ``start``, the offset in the text that joins all blocks by newlines.

    Two levels: a running sum inside each document, and one over the documents' totals. The second is
    split by ranges of documents, so that no task orders more than one range.
    """
    inside = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumn("local", F.coalesce(F.sum(F.col("len") + 1).over(inside), F.lit(0)))
    totals = blocks.groupBy("doc").agg(F.sum(F.col("len") + 1).alias("total"))
    totals = totals.withColumn("part", F.floor(F.col("doc") / 4096))
    parts = totals.groupBy("part").agg(F.sum("total").alias("part_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_total").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("in_part", F.coalesce(F.sum("total").over(within), F.lit(0))).join(parts, "part").select("doc", (F.col("part_base") + F.col("in_part")).alias("base"))
    return local.join(bases, "doc").withColumn("start", F.col("base") + F.col("local")).drop("local", "base")


def document_spans(blocks: DataFrame) -> DataFrame:
    """``(doc, first, last)``: start of the first and end of the last block; needs ``start``."""
    return blocks.groupBy("doc").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("len")).alias("last"))


def asof_segment(positions: DataFrame, blocks: DataFrame) -> DataFrame:
    """``positions(part, pos)`` with the block that begins last at or before them, by part."""
    both = positions.select("part", "pos", F.lit(1).alias("side"), F.lit(None).cast("long").alias("start")).unionByName(blocks.select("part", F.col("start").alias("pos"), F.lit(0).alias("side"), F.col("start").cast("long")))
    w = Window.partitionBy("part").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("start", F.last("start", ignorenulls=True).over(w)).where("side = 1").drop("side")


def toc(blocks: DataFrame, limit: int = 300) -> DataFrame:
    """``(doc, ord, title, n)``: the first ``limit`` heading lines of each document."""
    w = Window.partitionBy("doc").orderBy("ord")
    return blocks.where(tx.is_heading(F.col("text"))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("doc", "ord", F.trim("text").alias("title"), "n")


def fill_language(lines: DataFrame, default: str, lang: str = "lang") -> DataFrame:
    """Lines whose language is null or neutral take that of the line before, the first the default."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col(lang) != "neutral", F.col(lang))
    return lines.withColumn(lang, F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit(default)))


def tagged_lines(blocks: DataFrame, part: str = lg.KANA, whole: str = lg.HAN, foreign: str = "ja", main: str = "zh", least: float = lg.JAPANESE_SHARE) -> DataFrame:
    """Blocks with a filled language."""
    return fill_language(blocks.withColumn("lang", lg.line_language(F.col("text"), part, whole, foreign, main, least)), main)


def split_visible(lines: DataFrame, main: str = "zh") -> DataFrame:
    """``(doc, visible, foreign)``: the lines of the main language and the others, joined by newlines."""
    joined = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ord", "text")))), lambda x: x.text), "\n")
    return lines.groupBy("doc").agg(joined(F.col("lang") == main).alias("visible"), joined(F.col("lang") != main).alias("foreign"))


def language_runs(lines: DataFrame) -> DataFrame:
    """``(doc, run, lang, first_ord, last_ord, text)``: neighbouring lines of one language as one run."""
    w = Window.partitionBy("doc").orderBy("ord")
    fresh = F.when(F.lag("lang").over(w).eqNullSafe(F.col("lang")), 0).otherwise(1)
    d = lines.withColumn("run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x.text), "\n")
    return d.groupBy("doc", "run", "lang").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), text.alias("text"))


def drop_paired_runs(runs: DataFrame, foreign: str = "ja", main: str = "zh") -> DataFrame:
    """Runs without the foreign ones that a run of the main language follows; neutral runs between go too."""
    w = Window.partitionBy("doc").orderBy("run")
    d = runs.withColumn("before", F.lag("lang").over(w)).withColumn("fresh", F.when((F.col("lang") == main) | F.col("before").isNull() | (F.col("before") == main), 1).otherwise(0))
    d = d.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shape = d.groupBy("doc", "island").agg(F.max((F.col("lang") == foreign).cast("int")).alias("has_foreign"), F.max((F.col("lang") == main).cast("int")).alias("is_main"))
    order = Window.partitionBy("doc").orderBy("island")
    shape = shape.withColumn("next_main", F.coalesce(F.lead("is_main").over(order), F.lit(0)))
    gone = shape.where("is_main = 0 and has_foreign = 1 and next_main = 1").select("doc", "island")
    return d.join(gone, ["doc", "island"], "left_anti").select(*runs.columns)


def from_first_main(lines: DataFrame, main: str = "zh") -> DataFrame:
    """Bilingual documents without what stands before their first line of the main language."""
    w = Window.partitionBy("doc")
    first = F.min(F.when(F.col("lang") == main, F.col("ord"))).over(w)
    both = F.max(F.when(F.col("lang") != main, 1)).over(w).isNotNull() & first.isNotNull()
    return lines.withColumn("_from", F.when(both, first)).where("_from is null or ord >= _from").drop("_from")


def recover_blocks(blocks: DataFrame, main: str) -> tuple[DataFrame, DataFrame]:
    """(recovered, remaining): blocks of the main language, and all others; no block is lost."""
    test = F.coalesce(F.col("lang") == main, F.lit(False))
    return blocks.where(test).withColumn("origin", F.lit("recovered")), blocks.where(~test)


def language_profile(documents: DataFrame, part: str = lg.KANA, whole: str = lg.HAN) -> DataFrame:
    """``(doc, chars, n_part, n_whole, share)`` of every document."""
    t = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").alias("doc"), F.length(t).cast("long").alias("chars"), lg.count_of(t, part).alias("n_part"), lg.count_of(t, whole).alias("n_whole"), lg.share_of(t, part, whole).alias("share"))
