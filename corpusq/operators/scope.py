"""Scopes, taxonomy roll-ups and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.sources.storage import checkpointed

UNCATEGORISED = "未分类"


def scopes(docs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(scope_key, doc)`` for ``top:``, ``work:`` and ``sub:`` keys.

    ``docs(doc, work, sub)`` and ``taxonomy(top, work)``; a top scope is the union of its works.
    """
    d = docs.join(taxonomy.select("top", "work"), "work", "left")
    keys = F.array_compact(F.array(F.concat(F.lit("top:"), "top"), F.concat(F.lit("work:"), "work"), F.concat(F.lit("sub:"), "work", F.lit("|"), "sub")))
    return d.select(F.explode(keys).alias("scope_key"), "doc").distinct()


def in_scope(rows: DataFrame, scope_table: DataFrame, scope: str = "scope") -> DataFrame:
    """Rows whose document lies in their scope; empty or ``all`` is no filter, an unknown key none."""
    free = F.coalesce(F.col(scope), F.lit("")).isin("", "all")
    held = rows.where(~free).join(scope_table.withColumnRenamed("scope_key", scope), [scope, "doc"], "left_semi")
    return rows.where(free).unionByName(held.select(*rows.columns))


def scope_bitmaps(scope_table: DataFrame) -> DataFrame:
    """``(scope_key, bucket, bits)``: the documents of each scope as bitmaps, a row for 32 768 ids."""
    at, bit = F.bitmap_bucket_number("doc"), F.bitmap_bit_position("doc")
    return scope_table.groupBy("scope_key", at.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def within(rows: DataFrame, asked: DataFrame, bitmaps: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows of ``rows(query_id, doc, …)`` whose document lies in their query's scope, ``asked(query_id, scope)``.

    An empty scope, ``all`` or none at all is no filter, an unknown key gives nothing, and neither does
    a query that ``asked`` does not have. Every row meets one bitmap at most.
    """
    d = rows.join(asked.select("query_id", F.coalesce("scope", F.lit("")).alias("_scope")), "query_id")
    d = d.withColumns({"_bucket": F.bitmap_bucket_number(F.col(doc)), "_bit": F.bitmap_bit_position(F.col(doc))})
    maps = bitmaps.select(F.col("scope_key").alias("_scope"), F.col("bucket").alias("_bucket"), "bits")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.coalesce(F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1, F.lit(False))
    d = d.join(maps, ["_scope", "_bucket"], "left").withColumn("_byte", byte)
    return d.where(F.col("_scope").isin("", "all") | held).select(*rows.columns)


def scope_counts(docs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(top, work, sub, docs)`` at all three levels; coarser ones leave the finer keys null."""
    d = docs.join(taxonomy.select("top", "work"), "work")
    return d.groupingSets([["top"], ["top", "work"], ["top", "work", "sub"]], "top", "work", "sub").agg(F.countDistinct("doc").alias("docs"))


def sub_of(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """``docs`` with ``sub``: the label of the first rule of the work whose part the file name holds.

    ``rules(work, ord, part, label)``; a null part is the work's default. The rules are a small,
    curated table.
    """
    hit = docs.select("doc", "work", "file").join(rules, "work").where(F.col("part").isNull() | F.contains("file", "part"))
    first = hit.groupBy("doc").agg(F.min_by("label", F.struct(F.col("part").isNull(), F.col("ord"))).alias("sub"))
    return docs.join(first, "doc", "left")


def facet_counts(entries: DataFrame, name_part: str = "", cat: str = "cat", name: str = "term") -> DataFrame:
    """``(cat, n)`` of the entries whose name contains the part; the filter on category does not apply."""
    c = F.coalesce(F.nullif(F.col(cat), F.lit("")), F.lit(UNCATEGORISED))
    return entries.where(F.contains(F.lower(F.col(name)), F.lit(name_part.lower()))).groupBy(c.alias("cat")).agg(F.count("*").alias("n"))


def filter_leaf(entries: DataFrame, name_part: str = "", category: str | None = None, cat: str = "cat", name: str = "term") -> DataFrame:
    """Entries of a leaf page, by part of the name and by category."""
    d = entries.where(F.contains(F.lower(F.col(name)), F.lit(name_part.lower())))
    c = F.coalesce(F.nullif(F.col(cat), F.lit("")), F.lit(UNCATEGORISED))
    return d.where(c == category) if category else d


def tree_counts(leaves: DataFrame) -> DataFrame:
    """``leaves(top, work, sub, n)`` rolled up; nodes without terms are left out."""
    return leaves.rollup("top", "work", "sub").agg(F.sum("n").alias("n"), F.count("*").alias("leaves")).where("n > 0 and top is not null")


def count_tree(nodes: DataFrame) -> DataFrame:
    """``(node, n)``: own counts plus those of all nodes below, ``nodes(node, parent, n)`` being a forest of any depth.

    After round k every node knows the counts less than 2^k levels below it, and its ancestor 2^k
    levels above; a round passes each node's sum to that ancestor and doubles the distance. So there
    are as many rounds as the depth has binary digits, each over one row per node, and each is
    checkpointed. A node of a cycle is an error.
    """
    d = checkpointed(nodes.select("node", F.col("parent").alias("up"), F.col("n").cast("long").alias("n")))
    known = d.select(F.col("node").alias("up")).distinct().withColumn("_there", F.lit(True))
    d = d.join(known, "up", "left").select("node", F.when(F.col("_there"), F.col("up")).alias("up"), "n")
    left = int(d.count()).bit_length() + 1
    while not d.where("up is not null").isEmpty():
        if not left:
            raise ValueError("the parents form a cycle")
        left -= 1
        passed = d.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("_below"))
        above = d.select(F.col("node").alias("up"), F.col("up").alias("_next")).where("_next is not null")
        d = checkpointed(d.join(passed, "node", "left").join(above, "up", "left").select("node", F.col("_next").alias("up"), (F.col("n") + F.coalesce("_below", F.lit(0))).alias("n")))
    return d.select("node", "n")


def rank_of(value: Column, ranks: dict[str, int], default: float) -> Column:
    """A rank from a short fixed list, the default for all others."""
    if not ranks:
        return F.lit(float(default))
    table = F.create_map(*(x for k, v in ranks.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(F.get(F.array(F.element_at(table, value)), F.lit(0)), F.lit(float(default)))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int, by: list[str] | None = None) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` of each key, with ``n``, ``total`` and ``has_more``."""
    by = by or []
    if not by:
        total = rows.count()
        return rows.orderBy(*order).offset(offset).limit(limit).withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(total > offset + limit)})
    w = Window.partitionBy(*by)
    d = rows.withColumn("n", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return d.where((F.col("n") > offset) & (F.col("n") <= offset + limit)).withColumn("has_more", F.col("total") > offset + limit)
