"""Search of a table of queries: definitions, interviews, questions, statistics and sampled passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.operators import aliases as al
from corpusq.operators import glossary as gl
from corpusq.operators import occurrences as oc
from corpusq.operators.multiterm import matched_units
from corpusq.operators.ordering import numbered
from corpusq.operators.scope import within
from corpusq.sources.storage import checkpointed

#: Interviews and questions, related terms, passages that a search lists.
LISTED, RELATED, PASSAGES = 8, 12, 60


def canonical_queries(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(query_id, q, canonical, targets, ambiguous)``: an alias with one target stands for it, one with several is ambiguous."""
    r = al.resolve_alias(queries, aliases)
    one = F.size("targets") == 1
    return r.select("query_id", "q", F.when(one, F.get("targets", F.lit(0))).otherwise(F.col("q")).alias("canonical"), "targets", F.coalesce(F.size("targets") > 1, F.lit(False)).alias("ambiguous"))


def scoped(rows: DataFrame, queries: DataFrame, scopes: DataFrame | None, doc: str = "doc") -> DataFrame:
    """``rows`` in the scopes of their ``queries(query_id, q, scope)``; without ``scopes``, bitmaps of ``scope.scope_bitmaps``, all of them."""
    return rows if scopes is None else within(rows, queries.select("query_id", "scope").distinct(), scopes, doc)


def definitions(queries: DataFrame, aliases: DataFrame, entries: DataFrame, parts: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """Ranked definitions: ``(query_id, entry_id, group_id, match, place)``.

    An ambiguous alias gives the exact cards of all its targets, in their order; other queries are
    looked up by their canonical form. A query without any card takes the exact ones of its first
    fallback part that has some: ``parts(query_id, part, place)``. With ``scopes`` and a column ``scope``
    of the queries, entries have a column ``doc``, and only those in scope are ranked.
    """
    c = canonical_queries(queries, aliases)
    plain = c.where("not ambiguous").select("query_id", F.lit(0).alias("target"), F.col("canonical").alias("q"))
    several = c.where("ambiguous").select("query_id", F.posexplode("targets").alias("target", "q"))

    def ranked(asked: DataFrame, exact: bool) -> DataFrame:
        keyed = asked.select(F.struct("query_id", "target").alias("query_id"), "q")
        m = gl.match_entries(keyed, entries.select("entry_id", "term", "body"))
        m = m.where("match = 'exact'") if exact else m
        m = m.join(keyed, "query_id").join(entries, "entry_id")
        if scopes is not None:
            m = scoped(m.withColumnsRenamed({"query_id": "_key"}).withColumn("query_id", F.col("_key.query_id")), queries, scopes).drop("query_id").withColumnRenamed("_key", "query_id")
        return gl.rank_definitions(m).select("query_id.query_id", "query_id.target", "entry_id", "group_id", "match", "place")

    found = ranked(plain, False).unionByName(ranked(several, True))
    if parts is not None:
        bare = parts.join(found.select("query_id").distinct(), "query_id", "left_anti")
        more = ranked(bare.select("query_id", F.col("place").cast("int").alias("target"), F.col("part").alias("q")), True)
        first = more.groupBy("query_id").agg(F.min("target").alias("target"))
        found = found.unionByName(more.join(first, ["query_id", "target"], "left_semi").select(*found.columns))
    once = Window.partitionBy("query_id", "group_id").orderBy("target", "place")
    found = found.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("target", "place"))).drop("_n", "target")


def variant_hits(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(query_id, doc, ord, n)``: matches of one alternation of all variants of a query, ``variants(query_id, term)``.

    Places at which several variants match count once, as the alternation finds them.
    """
    found = checkpointed(oc.occurrences(variants, blocks, positions=False).groupBy("query_id", "doc", "ord").agg(F.sum("n").alias("n"), F.count("*").alias("_terms")))
    one, more = found.where("_terms = 1").drop("_terms"), found.where("_terms > 1").drop("_terms", "n")
    pattern = variants.groupBy("query_id").agg(F.concat(F.lit("(?iu)"), tx.terms_pattern(F.array_sort(F.collect_set("term")))).alias("_p"))
    more = more.join(blocks.select("doc", "ord", "text"), ["doc", "ord"]).join(pattern, "query_id")
    return one.unionByName(more.select("query_id", "doc", "ord", F.regexp_count("text", F.col("_p")).cast("long").alias("n")))


def first_matches(queries: DataFrame, rows: DataFrame, text: str, limit: int = LISTED, scopes: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc, ord, place)``: the first rows of ``rows(doc, ord, text)`` that match each ``q``, in its scope."""
    near = oc.near_blocks(queries.select("query_id", F.col("q").alias("term")), rows.select("doc", "ord", F.col(text).alias("text")))
    hit = near.join(rows.select("doc", "ord", F.col(text).alias("text")), ["doc", "ord"]).where(tx.matches(F.col("text"), F.col("term")))
    hit = scoped(hit, queries, scopes)
    w = Window.partitionBy("query_id").orderBy("doc", "ord")
    return hit.select("query_id", "doc", "ord", F.row_number().over(w).alias("place")).where(F.col("place") <= limit)


def search(queries: DataFrame, aliases: DataFrame, variants: DataFrame, entries: DataFrame, interviews: DataFrame, qa: DataFrame, blocks: DataFrame, docs: DataFrame, related: DataFrame, leaves: DataFrame, limit: int = PASSAGES, parts: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """All that a query shows, in one table: ``(query_id, section, place, doc, ord, label, n)``.

    Sections: ``definition`` (doc is the entry, label its match), ``interview`` and ``qa`` (first
    LISTED by document and place; questions by their own text), ``related`` (label the term, n the
    shared blocks), ``classification`` (label the leaf), ``work`` (label the work, n the matches, ord
    the passages, doc the documents), ``passage`` (works in turn, kinds in order, each document once
    before repeats) and ``mode`` (subphrase for definitions without passages, else exact). With
    ``scopes`` and a column ``scope`` of the queries, all but ``related`` and ``classification`` keep to
    the scope, before anything is ranked or cut.
    """
    c = canonical_queries(queries, aliases)
    asked = c.select("query_id", F.col("canonical").alias("q"))
    asked = asked if scopes is None else asked.join(queries.select("query_id", "scope"), "query_id")
    shape = lambda d, section, place, doc, ord_, label, n: d.select("query_id", F.lit(section).alias("section"), F.expr(f"cast({place} as long)").alias("place"), F.expr(f"cast({doc} as long)").alias("doc"), F.expr(f"cast({ord_} as long)").alias("ord"), F.expr(f"cast({label} as string)").alias("label"), F.expr(f"cast({n} as long)").alias("n"))
    # Cards and hits are used by several sections, and are found once.
    cards = checkpointed(gl.cap_cards(definitions(queries, aliases, entries, parts, scopes)))
    hits = checkpointed(scoped(variant_hits(variants, blocks), queries, scopes))
    d = hits.join(docs.select("doc", "work", "kind_rank", "work_rank"), "doc")
    per = hits.groupBy("query_id", "doc").agg(F.sum("n").alias("n"), F.count("*").alias("passages")).join(docs.select("doc", "work", "work_rank"), "doc")
    works = per.groupBy("query_id", "work", "work_rank").agg(F.sum("n").alias("n"), F.sum("passages").alias("passages"), F.count("*").alias("docs"))
    works = works.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("work_rank", "work")))
    picked = oc.round_robin(oc.diversify(d, 8), limit)
    canon = asked.select("query_id", F.lower("q").alias("k"))
    rel = canon.join(related.select(F.lower("term").alias("k"), "other", "n", "place").where(F.col("place") <= RELATED), "k")
    cls = canon.join(leaves.select(F.lower("term").alias("k"), F.explode("leaves").alias("leaf")), "k").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("leaf")))
    has = lambda t, name: t.select("query_id").distinct().withColumn(name, F.lit(True))
    mode = queries.select("query_id").join(has(hits, "h"), "query_id", "left").join(has(cards, "d"), "query_id", "left")
    mode = mode.select("query_id", F.when(F.col("h").isNull() & F.col("d").isNotNull(), "subphrase").otherwise("exact").alias("label"))
    out = [
        shape(cards, "definition", "card", "entry_id", "null", "match", "null"),
        shape(first_matches(asked, interviews, "text", scopes=scopes), "interview", "place", "doc", "ord", "null", "null"),
        shape(first_matches(asked, qa, "q", scopes=scopes), "qa", "place", "doc", "ord", "null", "null"),
        shape(rel, "related", "place", "null", "null", "other", "n"),
        shape(cls, "classification", "place", "null", "null", "leaf", "null"),
        shape(works, "work", "place", "docs", "passages", "work", "n"),
        shape(picked, "passage", "pick", "doc", "ord", "work", "n"),
        shape(mode, "mode", "1", "null", "null", "label", "null"),
    ]
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def list_units(units: DataFrame, docs: DataFrame, offset: int, limit: int, work: str | None = None, asked: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """A page of a multi-term query's units by work and place: ``rank``, ``total`` and ``has_more``.

    The level is that of the units in scope, ``asked(query_id, scope)``.
    """
    masks = checkpointed(units.select("query_id", "doc", "ord", "mask"))  # scanned once, for level, ranks and totals
    d = matched_units(masks if scopes is None else scoped(masks, asked, scopes)).join(docs.select("doc", "work"), "doc")
    d = d.where(F.col("work") == work) if work else d
    totals = d.groupBy("query_id").agg(F.count("*").alias("total"))
    d = numbered(d, ["query_id"], ["work"], ["doc", "ord"], "rank").where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return d.join(totals, "query_id").withColumn("has_more", F.col("total") > offset + limit)
