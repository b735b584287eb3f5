"""Co-occurrence of several term groups, with relaxation and fragments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.positions import shortest_span
from corpusq.functions.text import let, tidy_snippet
from corpusq.operators.occurrences import occurrences
from corpusq.operators.scope import within
from corpusq.operators.snippets import SHORT, SPAN, block_window, with_snippets

#: Units of a query that are expanded into fragments; anchors of a group and of a unit; half of a fallback window.
MOST_UNITS, GROUP_ANCHORS, UNIT_ANCHORS, AROUND = 200, 20, 40, 200
#: Interviews and questions that a search lists.
LISTED = 8


def match_units(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(query_id, doc, ord, mask, groups, span)``: what each block holds of each query.

    ``groups(query_id, group, term)`` may name several terms for a group. Every group is matched on
    its own, so a longer term of one group never hides a term of another. ``groups`` maps group to
    sorted positions; ``span`` is the shortest window over the groups that occur. Each distinct term
    is looked for once, whatever number of queries ask for it.
    """
    asked = groups.select("query_id", "group", "term").distinct()
    words = asked.select(F.col("term").alias("query_id"), "term").distinct()
    hits = occurrences(words, blocks).select("term", "doc", "ord", "positions").join(asked, "term")
    merge = lambda lists: F.when(F.size(lists) == 1, F.get(lists, F.lit(0))).otherwise(F.array_sort(F.array_distinct(F.flatten(lists))))
    # The mask is an aggregate of its own: who asks for nothing else finds no positions and sorts no lists.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("group").cast("int"))
    rows = hits.groupBy("query_id", "doc", "ord").agg(F.bit_or(bit).alias("mask"), F.sort_array(F.collect_list(F.struct("group", "positions"))).alias("held"))
    numbers = F.array_distinct(F.transform("held", lambda h: h.group))
    per_group = F.transform(numbers, lambda g: F.struct(g.alias("group"), merge(F.transform(F.filter("held", lambda h: h.group == g), lambda h: h.positions)).alias("positions")))
    units = rows.select("query_id", "doc", "ord", "mask", per_group.alias("groups"))
    return units.withColumn("span", shortest_span(F.transform("groups", lambda g: g.positions)))


def effective_level(units: DataFrame) -> DataFrame:
    """``(query_id, level)``: the most groups that any unit of the query holds."""
    return units.groupBy("query_id").agg(F.max(F.bit_count("mask")).alias("level"))


def matched_units(units: DataFrame) -> DataFrame:
    """The units that reach their query's level; a row for each query is joined back, no window holds all units of one."""
    return units.withColumn("groups_held", F.bit_count("mask")).join(effective_level(units), "query_id").where("groups_held = level")


def ranked_units(units: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Matched units by span, work, document and place, with ``rank``; a limit cuts inside every partition first."""
    d = matched_units(units).join(docs.select("doc", "work"), "doc")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("span", "work", "doc", "ord")))
    return d.where(F.col("rank") <= limit) if limit else d


def unit_stats(units: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, work, units, docs)`` of the matched units, by work and for all works."""
    # All levels are counted and the highest is kept, so that blocks are scanned once.
    d = units.groupBy("query_id", "doc", F.bit_count("mask").alias("_level")).agg(F.count("*").alias("units")).join(docs.select("doc", "work"), "doc")
    sets = [["query_id", "_level", "work"], ["query_id", "_level"]]
    n = d.groupingSets(sets, "query_id", "_level", "work").agg(F.sum("units").alias("units"), F.count("*").alias("docs"))
    highest = F.max("_level").over(Window.partitionBy("query_id"))
    return n.withColumn("_highest", highest).where("_level = _highest").select("query_id", "work", "units", "docs")


def group_labels(units: DataFrame, groups: DataFrame) -> DataFrame:
    """``(query_id, doc, terms)``: the terms whose groups a document's units hold."""
    per = units.groupBy("query_id", "doc").agg(F.bit_or("mask").alias("mask"))
    first = groups.groupBy("query_id", "group").agg(F.min("term").alias("term"))
    held = per.join(first, "query_id").where(F.expr("(mask & shiftleft(1L, cast(group as int))) <> 0"))
    return held.groupBy("query_id", "doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "term"))), lambda x: x.term).alias("terms"))


def highlight_terms(groups: DataFrame) -> DataFrame:
    """``(query_id, terms)``: the variants of all groups in order, equal ones but for case once."""
    first = groups.groupBy("query_id", F.lower("term").alias("k")).agg(F.min(F.struct("group", "term")).alias("x"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.term).alias("terms"))


@F.pandas_udf(SPAN)
def _window(text: pd.Series, at: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([block_window(t, int(p), int(p) + 1) for t, p in zip(text, at)], columns=["start", "end"])


def fragments(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(query_id, doc, ord, start, end, mask, span, text)``: windows around anchors that hold the level.

    At most MOST_UNITS units of a query in corpus order, and as anchors the first GROUP_ANCHORS
    positions of each group, UNIT_ANCHORS in all, the groups in turn: this report's feature. Of
    windows of one block with the same wording the first stays. A unit none of whose windows holds the
    level gives one around the middle of its groups' first positions.
    """
    order = Window.partitionBy("query_id").orderBy("doc", "ord")
    few = matched_units(units).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= MOST_UNITS)
    few = few.join(blocks.select("doc", "ord", "text"), ["doc", "ord"]).select("query_id", "doc", "ord", "mask", "groups", "level", "span", "text")
    anchors = few.select("query_id", "doc", "ord", "level", "groups", "text", F.posexplode("groups").alias("_g", "g"))
    anchors = anchors.select("query_id", "doc", "ord", "level", "groups", "text", "_g", F.posexplode(F.slice("g.positions", 1, GROUP_ANCHORS)).alias("_i", "at"))
    key = ["query_id", "doc", "ord"]
    anchors = anchors.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_i", "_g"))).where(F.col("_n") <= UNIT_ANCHORS)
    anchors = anchors.withColumn("w", _window("text", "at"))
    held = F.transform("groups", lambda g: F.struct(g.group.alias("group"), F.filter(g.positions, lambda p: (p >= F.col("w.start")) & (p < F.col("w.end"))).alias("positions")))
    anchors = anchors.withColumn("_in", F.filter(held, lambda g: F.size(g.positions) > 0)).where(F.size("_in") >= F.col("level"))
    mask = F.aggregate("_in", F.lit(0).cast("long"), lambda acc, g: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), g.group.cast("int"))))
    cut = F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    found = anchors.select(*key, "_n", F.col("w.start").alias("start"), F.col("w.end").alias("end"), mask.alias("mask"), shortest_span(F.transform("_in", lambda g: g.positions)).alias("span"), cut.alias("text"))
    wording = Window.partitionBy(*key, F.regexp_replace("text", "\\s+", "")).orderBy("_n")
    found = found.withColumn("_f", F.row_number().over(wording)).where("_f = 1").drop("_n", "_f")
    firsts = F.transform("groups", lambda g: F.get(g.positions, F.lit(0)))
    middle = F.floor((F.array_min(firsts) + F.array_max(firsts)) / 2).cast("int")
    bare = few.join(found.select(*key).distinct(), key, "left_anti").withColumns({"start": F.greatest(F.lit(0), middle - AROUND), "end": F.least(F.length("text"), middle + AROUND)})
    bare = bare.select(*key, "start", "end", "mask", "span", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
    return found.unionByName(bare)


def fragment_snippets(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """``fragments`` with ``snippet``: the window as one line, with ellipses where it cuts the document.

    A block that is too short to stand alone takes its neighbours; what the fragment holds is counted in
    its own block all the same.
    """
    sizes = blocks.select("doc", "ord", F.length("text").alias("_size"))
    ends = blocks.groupBy("doc").agg(F.min("ord").alias("_first"), F.max("ord").alias("_last"))
    d = found.join(sizes, ["doc", "ord"]).join(ends, "doc")
    before, after = (F.col("start") > 0) | (F.col("ord") > F.col("_first")), (F.col("end") < F.col("_size")) | (F.col("ord") < F.col("_last"))
    short = F.col("_size") < SHORT
    alone = d.where(~short).withColumn("snippet", tidy_snippet(F.col("text"), before, after)).select(*found.columns, "snippet")
    return alone.unionByName(with_snippets(d.where(short).select(*found.columns), blocks).select(*found.columns, "snippet"))


def search_units(groups: DataFrame, texts: DataFrame, asked: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """Units of all kinds of text under one level: ``(query_id, kind, doc, item, mask, groups, span, level)``.

    ``texts(kind, doc, item, text)`` holds definitions, interviews, questions and blocks; ``item`` is
    the place of a text among those of its kind. With ``asked(query_id, scope)`` and ``scopes``, bitmaps
    of ``scope.scope_bitmaps``, the level is that of the units in scope.
    """
    as_blocks = texts.select(F.struct("kind", "doc").alias("doc"), F.col("item").alias("ord"), "text")
    units = match_units(groups, as_blocks)
    if scopes is not None:
        units = within(units.withColumns({"_unit": F.col("doc"), "doc": F.col("doc.doc")}), asked, scopes).drop("doc").withColumnRenamed("_unit", "doc")
    units = matched_units(units)
    return units.select("query_id", "doc.kind", "doc.doc", F.col("ord").alias("item"), "mask", "groups", "span", "level")


def search_multi(groups: DataFrame, texts: DataFrame, definitions: DataFrame, most_cards: int = 26, asked: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """What a multi-term query lists beside its passages: ``(query_id, kind, place, doc, item, span, terms, level, relaxed)``.

    Definitions by span, ``rank`` and item, one of each group, with the terms of all entries of the
    group, ``most_cards`` at most; the first LISTED interviews and questions by span, document and
    item. ``definitions(item, group_id, rank)`` describes the entries; ``relaxed`` says that no text
    holds all groups of the query. Passages are ``fragments`` of the units of kind ``block``. Scopes are
    those of ``search_units``.
    """
    units = search_units(groups, texts, asked, scopes)
    asked = groups.groupBy("query_id").agg(F.countDistinct("group").alias("asked"))
    labels = groups.groupBy("query_id", "group").agg(F.min("term").alias("term")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("group", "term"))).alias("labels"))
    cards = units.where("kind = 'definition'").join(definitions.select("item", "group_id", "rank"), "item")
    union = cards.groupBy("query_id", "group_id").agg(F.bit_or("mask").alias("_all"))
    one = cards.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy("span", "rank", "item"))).where("_n = 1")
    one = one.join(union, ["query_id", "group_id"]).withColumn("mask", F.col("_all"))
    one = one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("span", "rank", "item"))).where(F.col("place") <= most_cards)
    rest = units.where("kind in ('interview', 'qa')")
    rest = rest.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("span", "doc", "item"))).where(F.col("place") <= LISTED)
    columns = ["query_id", "kind", "place", "doc", "item", "span", "mask", "level"]
    every = one.select(*columns).unionByName(rest.select(*columns)).join(labels, "query_id").join(asked, "query_id")
    terms = let(F.struct("labels", "mask"), lambda x: F.transform(F.filter(x.labels, lambda g: F.call_function("shiftright", x.mask, g.group.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1), lambda g: g.term))
    return every.select("query_id", "kind", "place", "doc", "item", "span", terms.alias("terms"), "level", (F.col("level") < F.col("asked")).alias("relaxed"))
