"""Jobs that build tables: occurrence index, repaired sources, routes, volumes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import lang as lg
from corpusq.functions import text as tx
from corpusq.operators import blocks as bl
from corpusq.operators import story as st
from corpusq.sources.storage import checkpointed


def split_block_languages(blocks: DataFrame, part: str = lg.KANA, whole: str = lg.HAN, foreign: str = "ja", main: str = "zh", least: float = lg.JAPANESE_SHARE) -> DataFrame:
    """``(doc, ord, visible, foreign)``: the lines of each block by language; neutral lines go with the line before."""
    lines = blocks.select(F.struct("doc", "ord").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text")).where("trim(text) <> ''")
    both = bl.split_visible(bl.tagged_lines(lines, part, whole, foreign, main, least), main)
    return both.select("doc.doc", "doc.ord", "visible", "foreign")


def exact_copies(blocks: DataFrame, story_docs: DataFrame) -> DataFrame:
    """``(doc, reason, canonical)``: documents whose blank-free text another one has.

    Story documents stay, all of them; without one the smallest id stays.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x.text), "\n")
    keys = blocks.groupBy("doc").agg(F.sha2(F.encode(tx.match_key(text), "UTF-8"), 256).alias("k"), F.max(F.length(tx.match_key(F.col("text")))).alias("_size")).where("_size > 0")
    d = checkpointed(keys.join(story_docs.select("doc").distinct().withColumn("_story", F.lit(True)), "doc", "left").select("doc", "k", F.coalesce("_story", F.lit(False)).alias("story")))
    best = d.groupBy("k").agg(F.min_by("doc", F.struct(~F.col("story"), "doc")).alias("canonical"), F.count("*").alias("n")).where("n > 1")
    return d.join(best, "k").where("doc <> canonical and not story").select("doc", F.lit("exact_duplicate_text").alias("reason"), "canonical")


def build_index(candidates: DataFrame, docs: DataFrame, exclusions: DataFrame, chapters: DataFrame, clean: Callable[[Column], Column] = tx.clean_text, **languages) -> dict[str, DataFrame]:
    """The occurrence index: tables ``blocks``, ``foreign``, ``locations``, ``excluded``, ``profile``.

    ``candidates(doc, priority, source, ord, text)`` are blocks from several sources; of each document
    the best source with text after cleaning is taken. Excluded documents go, blocks are split by
    language, documents with the visible text of another go too. A block's path is that of its
    story chapter, ``chapters(doc, start, end, path)``, else work and title of ``docs(doc, work,
    title)``; neighbouring blocks of one path are one location.
    """
    cleaned = candidates.join(exclusions.select("doc"), "doc", "left_anti").withColumn("text", clean(F.col("text"))).where("trim(text) <> ''")
    best = cleaned.groupBy("doc").agg(F.min("priority").alias("priority"))
    chosen = cleaned.join(best, ["doc", "priority"]).select("doc", "ord", "text")
    both = checkpointed(split_block_languages(chosen, **languages))
    visible = both.where("visible <> ''").select("doc", "ord", F.col("visible").alias("text"))
    copies = exact_copies(visible, chapters.select("doc"))
    excluded = checkpointed(st.merge_exclusions(exclusions.select("doc", "reason", F.lit(None).cast("long").alias("canonical")), copies.select("doc", "reason", F.col("canonical").cast("long"))))
    gone = excluded.select("doc")
    visible = visible.join(gone, "doc", "left_anti")
    foreign = both.where("foreign <> ''").select("doc", "ord", F.col("foreign").alias("text")).join(gone, "doc", "left_anti")
    located = st.locate(visible, chapters).join(docs.select("doc", tx.path_of(F.col("work"), F.col("title")).alias("_fallback")), "doc", "left")
    located = located.select("doc", "ord", F.coalesce(F.nullif("path", F.lit("")), "_fallback").alias("path"))
    texts = visible.unionByName(foreign)
    sizes = texts.groupBy("doc").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("blocks"))
    return {"blocks": visible, "foreign": foreign, "locations": st.compact_locations(located), "excluded": excluded, "profile": sizes}


def repair_sources(documents: DataFrame, part: str = lg.KANA, whole: str = lg.HAN, foreign: str = "ja", main: str = "zh", least: float = lg.JAPANESE_SHARE) -> DataFrame:
    """``(doc, ord, lang, text)``: runs of one language of bilingual documents.

    Foreign runs that a run of the main language follows are its source and go; so does what stands
    before the first run of the main language.
    """
    lines = bl.blocks_from_documents(documents)
    runs = bl.drop_paired_runs(bl.language_runs(bl.tagged_lines(lines, part, whole, foreign, main, least)), foreign, main)
    return bl.from_first_main(runs.select("doc", F.col("run").alias("ord"), "lang", "text"), main)


def build_routes(events: DataFrame, docs: DataFrame, overrides: DataFrame, titles: DataFrame) -> DataFrame:
    """Chapters of a route from its event table: ``(work, route, doc, title, main_index, key, meta)``.

    ``events(work, route, name, ord, merge)``: rows with one ``merge`` are one chapter, the first of
    them. An event's document comes from ``overrides(name, doc)`` or by the stem of its file; events
    without one are left out. ``titles(name, title)`` translates; titles carry their number, and
    ``meta`` keeps the name and place that they came from.
    """
    e = events.withColumn("_merge", F.coalesce("merge", F.concat(F.lit("="), F.col("ord").cast("string"))))
    once = Window.partitionBy("work", "route", "_merge").orderBy("ord")
    e = e.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n", "_merge", "merge")
    d = st.event_documents(e, docs, overrides).where("doc is not null").join(titles.select("name", F.col("title").alias("_title")), "name", "left")
    n = F.row_number().over(Window.partitionBy("work", "route").orderBy("ord"))
    d = d.withColumn("main_index", n).withColumn("title", F.concat_ws(" ", F.expr("lpad(main_index, greatest(2, length(main_index)), '0')"), F.coalesce("_title", "name")))
    d = st.assign_keys(d.withColumn("meta", F.create_map(F.lit("event"), F.col("name"), F.lit("place"), F.col("ord").cast("string"))))
    return d.select("work", "route", "doc", "title", "main_index", "key", "meta")


def assemble_volume(blocks: DataFrame, declared: DataFrame, longest: int = 44) -> tuple[DataFrame, DataFrame]:
    """(chapters, audit) of volumes that several articles make up.

    ``blocks(volume, doc, ord, kind, text)`` in article order. The longest run of short lines before
    the first heading is a volume's table of contents; headings take the longest title of it that they
    begin with, else their own text; a chapter goes on through all articles of its volume under the
    same title. ``declared(volume, doc, chars)`` is what an article should hold.
    """
    w = Window.partitionBy("volume").orderBy("doc", "ord")
    d = checkpointed(blocks.withColumn("place", F.row_number().over(w)))
    first = d.where("kind = 'heading'").groupBy("volume").agg(F.min("place").alias("_first"))
    front = d.join(first, "volume").where("place < _first").select(F.col("volume").alias("doc"), F.col("place").alias("ord"), "text", (F.length("text") <= longest).alias("candidate"))
    run = st.longest_run(front)
    contents = front.join(run, "doc").where("ord >= start and ord < start + size").select("doc", F.trim("text").alias("title"))
    heads = d.where("kind = 'heading'").select(F.col("volume").alias("doc"), F.col("place").alias("ord"), "text")
    known = st.match_headings(heads, contents).select(F.col("doc").alias("volume"), F.col("ord").alias("place"), "title")
    named = d.join(known, ["volume", "place"], "left").withColumn("text", F.when(F.col("kind") == "heading", F.coalesce("title", "text")).otherwise(F.col("text"))).drop("title")
    under = st.assign_chapters(named.select(F.col("volume").alias("doc"), F.col("place").alias("ord"), "kind", "text"))
    parsed = d.where("kind <> 'heading'").groupBy("volume", "doc").agg(F.sum(F.length("text")).alias("parsed"))
    audit = st.coverage_audit(parsed.join(declared, ["volume", "doc"]).select("volume", "doc", "parsed", F.lit(0).alias("excluded"), F.col("chars").alias("declared")))
    return st.chapter_texts(under).withColumnRenamed("doc", "volume"), audit
