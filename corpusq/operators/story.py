"""Reading trees: chapters, locations, navigation, volume assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.sources.storage import bounded

#: Shingle length, and the steps of the indexed and of the probing side.
SHINGLE, INDEX_STEP, PROBE_STEP = 40, 160, 20


def flatten_story(story: DataFrame) -> DataFrame:
    """One row per chapter of ``story(work, root_chapters, routes)``, root chapters first.

    ``(work, route, route_ord, ord, title, doc, start, end)``; route is null for root chapters.
    """
    root = story.select("work", F.lit(None).cast("string").alias("route"), F.lit(-1).alias("route_ord"), F.posexplode("root_chapters").alias("ord", "c"))
    route = story.select("work", F.posexplode("routes").alias("route_ord", "r")).select("work", F.col("r.name").alias("route"), "route_ord", F.posexplode("r.chapters").alias("ord", "c"))
    return root.unionByName(route).select("work", "route", "route_ord", "ord", "c.title", "c.doc", "c.start", "c.end")


def flatten_official(parts: DataFrame) -> DataFrame:
    """One row per line of ``parts(part, chapters[title, sections[title, lines[s, t]]])``."""
    c = parts.select("part", F.posexplode("chapters").alias("chapter", "c"))
    s = c.select("part", "chapter", F.col("c.title").alias("title"), F.posexplode("c.sections").alias("section", "s"))
    return s.select("part", "chapter", "title", "section", F.col("s.title").alias("section_title"), F.size("s.lines").alias("lines"), F.posexplode("s.lines").alias("ord", "x")).select("part", "chapter", "title", "section", "section_title", "lines", "ord", F.col("x.s").alias("speaker"), F.col("x.t").alias("text"))


def close_ranges(chapters: DataFrame) -> DataFrame:
    """Chapters with ``end`` = next start in the document, null for the last."""
    w = Window.partitionBy("doc").orderBy("start")
    return chapters.withColumn("end", F.lead("start").over(w))


def chapter_nav(chapters: DataFrame, by: str = "work") -> DataFrame:
    """Chapters with previous and next key, index and total in their work."""
    w = Window.partitionBy(by).orderBy("ord")
    return chapters.withColumns({"prev_key": F.lag("key").over(w), "next_key": F.lead("key").over(w), "idx": F.row_number().over(w), "total": F.count("*").over(Window.partitionBy(by))})


def assign_keys(chapters: DataFrame) -> DataFrame:
    """Chapters with the stable key ``work::route::index``, ``root`` for those without a route."""
    route = F.coalesce("route", F.lit("root"))
    w = Window.partitionBy("work", route).orderBy("ord")
    return chapters.withColumn("key", F.concat_ws("::", "work", route, (F.row_number().over(w) - 1).cast("string")))


def locate(blocks: DataFrame, locations: DataFrame) -> DataFrame:
    """Blocks with the path of the interval [start, end) of their document that holds them; null for none."""
    loc = locations.select(F.col("doc").alias("_doc"), "start", "end", "path")
    on = (blocks["doc"] == loc["_doc"]) & (blocks["ord"] >= loc["start"]) & (F.col("end").isNull() | (blocks["ord"] < loc["end"]))
    return blocks.join(loc, on, "left").drop("_doc", "start", "end")


def chapter_of(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Blocks with the title of their chapter; before the first and after the last they are clamped."""
    closed = close_ranges(chapters)
    ends = closed.groupBy("doc").agg(F.min_by("title", "start").alias("first_title"))
    found = locate(blocks, closed.withColumn("path", F.col("title")))
    return found.join(ends, "doc", "left").withColumn("chapter", F.coalesce("path", "first_title")).drop("path", "first_title")


def compact_locations(blocks: DataFrame) -> DataFrame:
    """``(doc, start, end, path)``: blocks with consecutive places and one path as one half-open interval."""
    w = Window.partitionBy("doc").orderBy("ord")
    fresh = F.when(F.lag("path").over(w).eqNullSafe(F.col("path")) & (F.lag("ord").over(w) == F.col("ord") - 1), 0).otherwise(1)
    d = blocks.withColumn("run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("doc", "run", "path").agg(F.min("ord").alias("start"), (F.max("ord") + 1).alias("end")).drop("run")


def path_by_shingle(blocks: DataFrame, located: DataFrame) -> DataFrame:
    """``(doc, ord, path)`` of blocks whose text shares a 40-character piece with a located block of the work.

    ``located(work, text, path)`` is cut every INDEX_STEP characters, the probing blocks every
    PROBE_STEP, both without white space. Of several hits the earliest probe wins. Texts of 40
    characters or fewer have no piece on the indexed side.
    """
    flat = F.regexp_replace("text", "\\s+", "")
    # A text of exactly SHINGLE characters has no indexed piece, hence the strict comparison.
    index = located.select("work", "path", flat.alias("flat")).where(F.length("flat") > SHINGLE)
    index = index.select("work", "path", F.explode(F.expr(f"transform(sequence(0, length(flat) - {SHINGLE + 1}, {INDEX_STEP}), k -> substring(flat, k + 1, {SHINGLE}))")).alias("piece"))
    index = index.groupBy("work", "piece").agg(F.min("path").alias("path"))
    probe = blocks.select("work", "doc", "ord", flat.alias("flat")).where(F.length("flat") >= SHINGLE)
    probe = probe.select("work", "doc", "ord", F.posexplode(F.expr(f"transform(sequence(0, length(flat) - {SHINGLE}, {PROBE_STEP}), k -> substring(flat, k + 1, {SHINGLE}))")).alias("k", "piece"))
    return probe.join(index, ["work", "piece"]).groupBy("doc", "ord").agg(F.min_by("path", "k").alias("path"))


def resolve_starts(chapters: DataFrame, last_blocks: DataFrame) -> DataFrame:
    """Chapters whose null start becomes the next known start of the document, else its last block."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    d = chapters.withColumn("start", F.first("start", ignorenulls=True).over(w)).join(last_blocks.select("doc", "last_ord"), "doc", "left")
    return d.withColumn("start", F.coalesce("start", "last_ord")).drop("last_ord")


def longest_run(rows: DataFrame, candidate: str = "candidate") -> DataFrame:
    """``(doc, start, size)`` of the longest run of consecutive candidate rows; the first of equal ones."""
    w = Window.partitionBy("doc").orderBy("ord")
    d = rows.withColumn("idx", F.row_number().over(w)).where(F.col(candidate))
    d = d.withColumn("island", F.col("idx") - F.row_number().over(w))
    runs = d.groupBy("doc", "island").agg(F.min("ord").alias("start"), F.count("*").alias("size"))
    return runs.groupBy("doc").agg(F.max_by(F.struct("start", "size"), F.struct("size", -F.col("start"))).alias("x")).select("doc", "x.start", "x.size")


def assign_chapters(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """Paragraphs with the title of the latest heading; those of excluded sections are dropped.

    ``blocks(doc, ord, kind, text)`` with kind ``heading`` or another. The flag of an excluded
    heading holds until the next one.
    """
    w = Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("kind") == "heading", F.trim("text")), ignorenulls=True).over(w)
    d = blocks.withColumn("title", title).where("kind <> 'heading' and title is not null")
    return d.where(~tx.is_excluded_section(F.col("title")))


def chapter_texts(paragraphs: DataFrame) -> DataFrame:
    """``(doc, title, paragraphs, text)``: the paragraphs of a title joined in order, wherever it continues."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x.text), "\n")
    return paragraphs.groupBy("doc", "title").agg(F.count("*").alias("paragraphs"), text.alias("text"))


def match_headings(headings: DataFrame, contents: DataFrame) -> DataFrame:
    """Headings with the longest expected title they begin with; an annotated suffix is allowed."""
    c = contents.select(F.col("doc").alias("_doc"), F.col("title").alias("expected"))
    hit = headings.join(c, (F.col("doc") == F.col("_doc")) & tx.is_chapter_heading(F.col("text"), F.col("expected")))
    return hit.groupBy("doc", "ord", "text").agg(F.max_by("expected", F.length("expected")).alias("title"))


def heading_blocks(headings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Headings with the first block at or after the one before them that has the same key.

    The choice is monotone inside a document: the n-th heading takes, of its matching blocks, the
    first one after all first matches of earlier headings.
    """
    b = blocks.select("doc", F.col("ord").alias("block"), tx.match_key(F.col("text")).alias("k"))
    h = headings.select("doc", F.col("ord").alias("heading"), tx.match_key(F.col("title")).alias("k"))
    hit = h.join(b, ["doc", "k"])
    lists = hit.groupBy("doc", "heading").agg(F.array_sort(F.collect_list("block")).alias("at"))
    per = lists.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("heading", "at"))).alias("hs"))
    step = lambda acc, h: F.when(F.size(F.filter(h["at"], lambda x: x >= acc.cursor)) > 0, F.struct((F.get(F.filter(h["at"], lambda x: x >= acc.cursor), F.lit(0)) + 1).alias("cursor"), F.concat(acc.out, F.array(F.struct(h.heading.alias("heading"), F.get(F.filter(h["at"], lambda x: x >= acc.cursor), F.lit(0)).alias("block")))).alias("out"))).otherwise(acc)
    none = F.struct(F.lit(0).alias("cursor"), F.expr("cast(array() as array<struct<heading:int,block:int>>)").alias("out"))
    return per.select("doc", F.explode(F.aggregate("hs", none, step, lambda acc: acc.out)).alias("x")).select("doc", "x.heading", "x.block")


def slice_between(rows: DataFrame, starts: str, ends: str) -> DataFrame:
    """Rows of each document from the first ``starts`` match to the next ``ends`` match, numbered anew."""
    w = Window.partitionBy("doc")
    d = rows.withColumn("_a", F.min(F.when(F.col("text").rlike(starts), F.col("ord"))).over(w))
    d = d.withColumn("_b", F.min(F.when(F.col("text").rlike(ends) & (F.col("ord") > F.col("_a")), F.col("ord"))).over(w))
    d = d.where((F.col("ord") >= F.col("_a")) & (F.col("_b").isNull() | (F.col("ord") < F.col("_b"))))
    return d.withColumn("n", F.row_number().over(w.orderBy("ord")) - 1).drop("_a", "_b")


def coverage_audit(articles: DataFrame, first: float = 0.07, other: float = 0.02) -> DataFrame:
    """``(doc, parsed, declared, diff, ok)``: parsed and excluded characters against the declared ones.

    The first article of a volume may differ by ``first``, others by ``other``.
    """
    w = Window.partitionBy("volume").orderBy("doc")
    d = articles.withColumn("n", F.row_number().over(w))
    diff = F.abs(F.col("parsed") + F.col("excluded") - F.col("declared")) / F.greatest(F.lit(1), F.col("declared"))
    return d.select("volume", "doc", "parsed", "declared", F.round(diff, 4).alias("diff"), (diff <= F.when(F.col("n") == 1, first).otherwise(other)).alias("ok"))


def order_groups(rows: DataFrame) -> DataFrame:
    """Rows of ``(node, idx, grp)`` with ``group_place``: ungrouped first, groups by first appearance; a single group counts as none."""
    w = Window.partitionBy("node", "grp")
    d = rows.withColumn("_first", F.min("idx").over(w))
    groups = F.size(F.collect_set("grp").over(Window.partitionBy("node")))
    loose = F.max(F.col("grp").isNull().cast("int")).over(Window.partitionBy("node"))
    d = d.withColumn("shown", F.when((groups == 1) & (loose == 0), F.lit(None).cast("string")).otherwise(F.col("grp")))
    order = Window.partitionBy("node").orderBy(F.col("shown").isNotNull(), F.when(F.col("shown").isNotNull(), F.col("_first")), "idx")
    return d.withColumn("group_place", F.row_number().over(order)).drop("_first")


def route_order(files: DataFrame) -> DataFrame:
    """Files of each work numbered for its route: ungrouped last, then by natural order of group and name."""
    w = Window.partitionBy("work").orderBy(F.col("grp").isNull(), tx.natural_key(F.coalesce("grp", F.lit(""))), tx.natural_key(F.col("name")), "name")
    return files.withColumn("place", F.row_number().over(w))


def number_rows(rows: DataFrame, key: str, order: str, prefix_width: int = 3) -> DataFrame:
    """First row of each key, numbered 1..n in order with a zero-padded prefix."""
    d = rows.withColumn("_n", F.row_number().over(Window.partitionBy("work", key).orderBy(order))).where("_n = 1").drop("_n")
    n = F.row_number().over(Window.partitionBy("work").orderBy(order))
    return d.withColumn("n", n).withColumn("prefix", F.lpad(n.cast("string"), prefix_width, "0"))


def doc_view(own: DataFrame, other: DataFrame) -> DataFrame:
    """``(doc, ord, lang, text)`` of two languages together, the second only where the first has the order."""
    held = other.join(own.select("doc", "ord"), ["doc", "ord"], "left_semi")
    return own.unionByName(held.select(*own.columns))


#: File numbers that stand for another chapter's.
MOVED = {400: 401}


def canonical_documents(chapters: DataFrame, docs: DataFrame, moved: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(canonical, exclusions): one document per official chapter.

    ``chapters(chapter, number, title[, part])``, ``docs(doc, file, title[, part])``. A document belongs
    to the chapter of its file's number, or of the number that ``moved`` gives for it; documents without
    such a chapter go by part and title, then by title alone, to the last chapter of that title. A
    chapter keeps a document of its own number before others, then the lowest id; the rest become
    exclusions.
    """
    moved = MOVED if moved is None else moved
    part = lambda t: F.coalesce(F.col("part"), F.lit("")) if "part" in t.columns else F.lit("")
    d = docs.select("doc", tx.int_prefix(F.col("file")).alias("_own"), tx.match_key(F.col("title")).alias("_k"), part(docs).alias("_p"))
    target = F.coalesce(*(F.when(F.col("_own") == k, v) for k, v in moved.items()), F.col("_own"))
    c = chapters.select("chapter", "number", tx.match_key(F.col("title")).alias("k"), part(chapters).alias("p"))
    by_number = c.where("number is not null").join(d.withColumn("_n", target), F.col("number") == F.col("_n")).select("chapter", "doc", F.when(F.col("_own") == F.col("number"), 0).otherwise(1).alias("way"))
    rest = d.join(by_number.select("doc"), "doc", "left_anti")
    by_title = c.join(rest, F.col("k") == F.col("_k")).groupBy("doc").agg(F.max(F.struct((F.col("p") == F.col("_p")).alias("same"), "chapter")).alias("x"))
    both = by_number.unionByName(by_title.select("x.chapter", "doc", F.lit(1).alias("way")))
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy("chapter").orderBy("way", "doc")))
    kept = ranked.where("n = 1").select("chapter", "doc")
    gone = ranked.where("n > 1").join(kept.withColumnRenamed("doc", "canonical"), "chapter").select("doc", F.lit("duplicate of an official chapter").alias("reason"), "canonical")
    return kept, gone.join(kept.select("doc"), "doc", "left_anti").distinct()


def merged_exclusions(docs: DataFrame, rules: DataFrame, chapters: DataFrame) -> DataFrame:
    """``(doc, reason, canonical_docs)``: documents tagged as merged, with the chapters of their route.

    ``rules(part, work, route)`` names the route of the documents whose file name holds ``part``; it is
    a small curated table, which is checked.
    """
    hit = docs.select("doc", "file").join(bounded(rules, "rules"), F.contains("file", "part"))
    own = chapters.groupBy("work", "route").agg(F.array_sort(F.collect_set("doc")).alias("canonical_docs"))
    return hit.join(own, ["work", "route"]).select("doc", F.lit("merged text").alias("reason"), "canonical_docs")


def merge_exclusions(preferred: DataFrame, others: DataFrame) -> DataFrame:
    """One exclusion per document, of the preferred list where it has one."""
    both = preferred.withColumn("_p", F.lit(0)).unionByName(others.withColumn("_p", F.lit(1)))
    w = Window.partitionBy("doc").orderBy("_p", "reason")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def choose_text(candidates: DataFrame) -> DataFrame:
    """Of ``candidates(doc, priority, source, text)`` the best source of each document that has text."""
    w = Window.partitionBy("doc").orderBy("priority")
    return candidates.where("trim(coalesce(text, '')) <> ''").withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def missing_chapters(expected: DataFrame, active: DataFrame, excluded: DataFrame) -> DataFrame:
    """Expected chapters that are neither active nor excluded."""
    return expected.join(active.unionByName(excluded), "chapter", "left_anti")


def event_documents(events: DataFrame, docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Event rows with their document: by override of the name, else by stem key; lowest id of several."""
    e = events.join(overrides.select("name", F.col("doc").alias("_own")), "name", "left").withColumn("_k", tx.stem_key(F.col("name")))
    d = docs.groupBy(tx.stem_key(F.col("file")).alias("_k")).agg(F.min("doc").alias("_doc"))
    return e.join(d, "_k", "left").withColumn("doc", F.coalesce("_own", "_doc")).drop("_own", "_doc", "_k")
