"""Filter interaction audit: what each filter removes in every order of all filters.

Documents become bit masks of the filters that they fail, and masks become counts, a cell per part
and mask, so the texts are read once. A recursive query then enumerates the orders: it extends
prefixes of filters by unused letters, joins the part's cells, carries the bits applied so far, and
every level emits the metrics of its step.

Null texts count as empty and null languages as the empty string; a null id is not larger or smaller
than any other, so it neither fails ``E`` nor makes others fail. Every row of a repeated id is a
document of its own. Of several labels of one id a 1 wins; documents without labels count as neither
good nor toxic. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.exprs import let
from corpusq.llm.scratch import materialize

#: The filters of ``failures``, the first with the lowest bit.
LETTERS = "ABCDE"
WORD = "[^\\x20\\x09-\\x0D]+"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def own_failures(text: Column) -> Column:
    """Bits of A to D, which a text fails by itself: short, repetitive, shouting, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    few = let(words, lambda w: F.when(F.size(w) < 200, 1).otherwise(0) + F.when(2 * F.size(F.array_distinct(w)) < F.size(w), 2).otherwise(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return few + F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each language and set of failed filters.

    ``E`` fails for texts that a smaller id has. Equal texts meet as counts: rows are counted by id
    first, then by text, and only the counts of one text, a few per language, stand together.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), own_failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("same"))
    by_id = rows.groupBy("doc_id", "part", "own", "same").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    marked = by_id.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_good", "is_toxic")})
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    by_text = marked.groupBy("same", "own", "part", "is_good", "is_toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("bare"), least.alias("least"))
    # A text has one cell of its smallest id at most per language and kind of label.
    ruled = by_text.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("same")))
    ruled = ruled.withColumn("kept", F.col("bare") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0))
    sides = F.array(F.struct(F.col("own").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
    cells = ruled.select("part", "is_good", "is_toxic", F.explode(sides).alias("x")).select("part", "is_good", "is_toxic", "x.mask", "x.n")
    held = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).cast("long")
    return cells.groupBy("part", "mask").agg(F.sum("n").cast("long").alias("n"), held("is_good").alias("good"), held("is_toxic").alias("toxic")).where("n > 0")


def _prefixes(cells: DataFrame, letters: str) -> DataFrame:
    """``(part, prefix, step, letter, …metrics)`` of every prefix of every order, by a recursive query."""
    spark = cells.sparkSession
    whole = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    filters = "array(" + ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(letters)) + ")"
    total = lambda where, of="n": f"aggregate(filter(c.cells, x -> {where}), 0L, (a, x) -> a + x.{of})"
    here, before = "(x.mask & f.bit) <> 0", "(x.mask & p.applied) <> 0"
    found = spark.sql(
        f"""
        WITH RECURSIVE prefixes (part, prefix, applied, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
            SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{whole}}
            UNION ALL
            SELECT p.part, concat(p.prefix, f.letter), p.applied | f.bit, p.step + 1, f.letter,
                   {total("(x.mask & (p.applied | f.bit)) = 0")}, {total(f"{here} AND NOT {before}")}, {total(f"{here} AND {before}")},
                   {total("x.mask = f.bit")}, {total(f"{here} AND NOT {before}", "good")}, {total(f"{here} AND NOT {before}", "toxic")}
            FROM prefixes p JOIN {{whole}} c ON p.part = c.part
            LATERAL VIEW explode(filter({filters}, f -> (p.applied & f.bit) = 0)) unused AS f)
        SELECT * FROM prefixes WHERE step > 0
        """,
        whole=materialize(whole, "cells"),
    )
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # rows grow with the parts; the levels are as many as letters
    try:
        return materialize(found, "prefixes")
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    ``cells(part, mask, n, good, toxic)`` are counts of documents by part and failed filters; bit i
    is ``letters[i]``. One row per part, order and step; ``shapley`` is what the step's filter removes
    in all orders together.
    """
    steps = _prefixes(cells, letters)
    orders = steps.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    rows = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)")).join(steps.drop("step", "applied"), ["part", "prefix"])
    shares = rows.groupBy("part", "letter").agg(F.sum("removed").cast("long").alias("shapley"))
    return rows.join(shares, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
