"""The reading tree: nodes, leaves, chapters, labels and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.operators.scope import count_tree
from corpusq.operators.story import chapter_nav
from corpusq.sources.storage import checkpointed

SEPARATOR = "||"


def _routes(chapters: DataFrame) -> DataFrame:
    """Chapters with ``shown``, the group they stand under: none for the route's own name, nor for a lone group."""
    grp = F.when((F.coalesce("grp", F.lit("")) == "") | (F.col("grp") == F.col("route")), F.lit(None).cast("string")).otherwise(F.col("grp"))
    d = chapters.withColumn("shown", grp)
    of = d.groupBy("work", "route").agg(F.countDistinct("shown").alias("_groups"), F.max(F.col("shown").isNull().cast("int")).alias("_loose"), F.min("shown").alias("_one"))
    lone = (F.col("_groups") == 1) & (F.col("_loose") == 0) & (F.col("official") | F.contains("route", "_one"))
    return d.join(of, ["work", "route"]).withColumn("shown", F.when(lone, F.lit(None).cast("string")).otherwise(F.col("shown"))).drop("_groups", "_loose", "_one")


def story_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters as they are read: where a work has official routes, its own main routes give way, extra ones stay.

    ``chapters(work, route, route_ord, grp, ord, title, doc, official, extra, sections)``; a null route
    is the work itself.
    """
    official = chapters.where("official").select("work").distinct().withColumn("_has", F.lit(True))
    d = chapters.join(official, "work", "left")
    return d.where("official or extra or route is null or _has is null").drop("_has")


def nav_nodes(chapters: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(node, parent, name, kind, place, n)``: tops, works, routes, groups; of official routes also chapters and sections.

    ``n`` counts the chapters that stand at a node itself; an official chapter is a node that counts
    one. Extra routes of a work with official ones are listed by ``story_leaf`` and are no nodes.
    ``taxonomy(top, work, top_ord, work_ord)``.
    """
    official = chapters.where("official").select("work").distinct().withColumn("_has", F.lit(True))
    d = chapters.join(official, "work", "left").where("official or route is null or _has is null")
    d = d.join(taxonomy, "work")
    work = F.concat(F.lit("work:"), "work")
    route = F.concat(work, F.lit(f"{SEPARATOR}route:"), "route")
    routed = _routes(d.where("route is not null"))
    group = F.concat(route, F.lit(f"{SEPARATOR}group:"), "shown")
    chapter = F.concat(route, F.lit(f"{SEPARATOR}chapter:"), F.col("doc").cast("string"))
    node = lambda t, key, parent, name, kind, place, n: t.select(key.alias("node"), parent.alias("parent"), name.alias("name"), F.lit(kind).alias("kind"), place.cast("long").alias("place"), n.cast("long").alias("n"))
    zero, none = F.lit(0), F.lit(None).cast("string")
    tops = node(d.groupBy("top").agg(F.min("top_ord").alias("o")), F.concat(F.lit("top:"), "top"), none, F.col("top"), "top", F.col("o"), zero)
    works = d.groupBy("work", "top").agg(F.min("work_ord").alias("o"), F.sum(F.col("route").isNull().cast("int")).alias("own"))
    works = node(works, work, F.concat(F.lit("top:"), "top"), F.col("work"), "work", F.col("o"), F.col("own"))
    routes = routed.groupBy("work", "route").agg(F.min("route_ord").alias("o"), F.sum((~F.col("official") & F.col("shown").isNull()).cast("int")).alias("own"))
    routes = node(routes, route, work, F.col("route"), "route", F.col("o"), F.col("own"))
    groups = routed.where("shown is not null").groupBy("work", "route", "shown").agg(F.min("ord").alias("o"), F.sum((~F.col("official")).cast("int")).alias("own"))
    groups = node(groups, group, route, F.col("shown"), "group", F.col("o"), F.col("own"))
    own = routed.where("official")
    heads = node(own, chapter, F.coalesce(group, route), F.col("title"), "chapter", F.col("ord"), F.lit(1))
    titles = F.when(F.size("sections") > 0, F.col("sections")).otherwise(F.array("title"))
    parts = own.select("work", "route", "doc", F.posexplode(titles).alias("section", "section_title"))
    parts = node(parts, F.concat(chapter, F.lit(f"{SEPARATOR}section:"), F.col("section").cast("string")), chapter, F.col("section_title"), "section", F.col("section"), zero)
    every = tops
    for x in (works, routes, groups, heads, parts):
        every = every.unionByName(x)
    return every


def story_tree(nodes: DataFrame) -> DataFrame:
    """``(node, parent, name, kind, place, chapters)`` of all nodes, counts including those below.

    Nodes and tree are written, as the counts go up level by level.
    """
    nodes = checkpointed(nodes)
    return checkpointed(nodes.drop("n").join(count_tree(nodes), "node").withColumnRenamed("n", "chapters"))


def story_node(tree: DataFrame, keys: DataFrame) -> DataFrame:
    """Of each ``keys(node)`` its children in order, with the breadcrumb of the node: ``(node, breadcrumb, child, name, chapters, place)``."""
    parts = keys.select("node", F.split("node", "\\|\\|", -1).alias("_p"))
    steps = parts.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("_p", F.lit(1), i), SEPARATOR).alias("key")))).alias("s"))
    names = steps.join(tree.select(F.col("node").alias("_node"), "name"), F.col("s.key") == F.col("_node"))
    crumb = names.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("s.i").alias("i"), "name"))), lambda x: x["name"]), " › ").alias("breadcrumb"))
    children = tree.select(F.col("parent").alias("node"), F.col("node").alias("child"), "name", "chapters", F.col("place").alias("_place"))
    d = keys.join(crumb, "node").join(children, "node")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("_place", "child"))).drop("_place")


def story_leaf(chapters: DataFrame) -> DataFrame:
    """Chapters of a work in reading order: its own first, then by route: ``(work, route, place, title, doc, official)`` and ``total``."""
    d = story_chapters(chapters)
    w = Window.partitionBy("work")
    order = [F.col("route").isNotNull(), ~F.col("official"), F.col("route_ord"), F.col("ord")]
    return d.select("work", "route", F.row_number().over(w.orderBy(*order)).alias("place"), F.count("*").over(w).alias("total"), "title", "doc", "official")


def official_chapter(chapters: DataFrame) -> DataFrame:
    """Official chapters with index, total and the titles before and after, in the order of their work."""
    w = Window.partitionBy("work").orderBy("route_ord", "ord")
    d = chapters.where("official").withColumn("_o", F.row_number().over(w)).select("work", "route", F.col("_o").alias("ord"), "title", F.col("doc").cast("string").alias("key"))
    titles = Window.partitionBy("work").orderBy("ord")
    d = chapter_nav(d).join(d.select("key", "work", F.lag("title").over(titles).alias("prev_title"), F.lead("title").over(titles).alias("next_title")), ["work", "key"])
    return d.select("work", F.col("key").alias("chapter"), F.col("route").alias("part"), "title", "idx", "total", "prev_key", "prev_title", "next_key", "next_title")


def in_chapter(ord_: Column, start: Column, end: Column, main: Column) -> Column:
    """Whether a block lies in [start, end); of the main language the first block also counts for an empty range."""
    inside = (ord_ >= start) & (end.isNull() | (ord_ < end))
    return inside | (main & (ord_ == start))


def chapter_blocks(chapters: DataFrame, blocks: DataFrame, main: str) -> DataFrame:
    """``(key, doc, ord, lang, text)``: the blocks of both languages of each ``chapters(key, doc, start, end)``."""
    c = chapters.select("key", F.col("doc").alias("_doc"), "start", "end")
    on = (F.col("doc") == F.col("_doc")) & in_chapter(F.col("ord"), F.col("start"), F.col("end"), F.col("lang") == main)
    return c.join(blocks, on).select("key", "doc", "ord", "lang", "text")


def scope_labels(scopes: DataFrame, tops: DataFrame, works: DataFrame) -> DataFrame:
    """``scopes(scope)`` with ``label``: of tops and works by their names, of others by the key; an empty scope is all works.

    ``tops(top, name)`` and ``works(work, label)``; a work without a label keeps its key.
    """
    kind, rest = F.substring_index("scope", ":", 1), F.regexp_replace("scope", "^[^:]*:", "")
    d = scopes.withColumns({"_top": F.when(kind == "top", rest), "_work": F.when(kind == "work", rest).when(kind == "sub", F.substring_index(rest, "|", 1)), "_sub": F.when(kind == "sub", F.regexp_replace(rest, "^[^|]*\\|", ""))})
    d = d.join(tops.select(F.col("top").alias("_top"), "name"), "_top", "left").join(works.select(F.col("work").alias("_work"), F.col("label").alias("_label")), "_work", "left")
    named = F.coalesce("_label", "_work")
    label = F.when(F.col("name").isNotNull(), F.concat("name", F.lit("（全部）"))).when(F.col("_sub").isNotNull(), F.concat(named, F.lit(" · "), "_sub")).when(F.col("_work").isNotNull(), named).otherwise("全部作品")
    return d.select("scope", label.alias("label"))


def source_struct(docs: DataFrame) -> DataFrame:
    """``(doc, source)``: the source of a document as one value; its translator stands in ``meta`` over one given there."""
    named = F.when(F.coalesce("translator", F.lit("")) != "", F.create_map(F.lit("translator"), F.col("translator"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    meta = F.map_concat(F.map_filter(F.coalesce("meta", F.expr("cast(map() as map<string,string>)")), lambda k, v: ~F.array_contains(F.map_keys(named), k)), named)
    return docs.select("doc", F.struct("title", "work", "kind", "file", meta.alias("meta"), F.col("doc").alias("id")).alias("source"))


def is_interview_source(kind: Column, file: Column, kinds: tuple[str, ...], prefix: str) -> Column:
    """A document of one of the interview kinds whose file lies under a prefix."""
    return kind.isin(*kinds) & F.startswith(F.regexp_replace(file, "\\\\", "/"), F.lit(prefix))


def occurrence_rows(hits: DataFrame, docs: DataFrame, locations: DataFrame) -> DataFrame:
    """Passages as they are shown: work, document, place, matches, source and path; a passage without a path has its title."""
    d = hits.join(docs.select("doc", "work", "title"), "doc").join(source_struct(docs), "doc").join(locations.select("doc", "ord", "path"), ["doc", "ord"], "left")
    return d.select("query_id", "work", "doc", "ord", "n", "source", F.coalesce(F.nullif("path", F.lit("")), "title").alias("path"))
