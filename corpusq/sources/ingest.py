"""Readers: bundles, language blocks, raw text files, pages, event tables, file lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.sources.storage import checkpointed

# Encodings of raw text files, in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-16", "gb18030")
# Elements without text of their own, and named character references.
SKIPPED = ("script", "style", "figure", "svg", "video", "audio")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))

DOCS = "id long, title string, work string, kind string, file string, chars long, lang string, ja_ratio double, official boolean, meta map<string,string>"
ENTRIES = "term string, source_term string, display_term string, cat string, body string, jp_body string, doc long, concept_id string, group_id string, entity_id string, source_unit_id string, translation_group_id string, variant_id string, authority string, translation_kind string, translator string, definition_quality int, is_primary boolean, is_meaning_primary boolean, truncated boolean, source_locator map<string,string>, source_refs array<struct<doc:long,start:int,end:int>>, conflict_flags array<string>"
QA = "q string, a string, doc long, truncated boolean"
INTERVIEWS = "term string, body string, jp_body string, doc long, entry_type string, source_locator map<string,string>"
BUNDLE = {"docs": DOCS, "entries": ENTRIES, "qa": QA, "interviews": INTERVIEWS}


def load_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four JSON tables of a bundle under fixed schemas; empty strings in text columns become null."""
    out = {}
    for name, schema in BUNDLE.items():
        d = spark.read.schema(schema).json(f"{folder}/{name}.json", multiLine=True)
        out[name] = d.select(*(F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in d.dtypes))
    return out


def load_lang_blocks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(doc, ord, text, lang)`` of JSON files that hold triples [doc, order, text], one file per language."""
    frames = []
    for lang, path in paths.items():
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("x"))
        frames.append(rows.select(F.get("x", F.lit(0)).cast("long").alias("doc"), F.get("x", F.lit(1)).cast("int").alias("ord"), F.get("x", F.lit(2)).alias("text"), F.lit(lang).alias("lang")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ingest_text(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(path, text, encoding)`` of raw files, one row each; newlines normalised, byte-order mark removed.

    The first of ENCODINGS that decodes a file without error is taken; a file that none decodes has
    null text and encoding.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f.path, f.content):
                text = encoding = None
                for name in ENCODINGS:
                    if name == "utf-16" and content[:2] not in (b"\xff\xfe", b"\xfe\xff"):
                        continue
                    try:
                        text, encoding = content.decode(name), name
                        break
                    except UnicodeDecodeError:
                        continue
                if text is not None:
                    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
                rows.append((path, text, encoding))
            yield pd.DataFrame(rows, columns=["path", "text", "encoding"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(decode, "path string, text string, encoding string")


def _without(html: Column, names: tuple[str, ...]) -> Column:
    for name in names:
        html = F.regexp_replace(html, f"(?is)<{name}\\b[^>]*>.*?</{name}>", "")
    return html


def page_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, ord, kind, text)``: headings, paragraphs and quotations of each page in order.

    Elements of SKIPPED go first, ``br`` becomes a newline, other tags are dropped, named character
    references replaced; empty blocks are left out. An unclosed paragraph ends where the next begins.
    """
    html = _without(F.coalesce("html", F.lit("")), SKIPPED)
    html = F.regexp_replace(html, "(?is)<!--.*?-->", "")
    parts = F.regexp_extract_all(html, F.lit("(?is)<(?:h[1-3]|p|blockquote)\\b[^>]*>.*?(?=<(?:h[1-3]|p|blockquote)\\b|</(?:h[1-3]|p|blockquote)>|$)"), F.lit(0))
    d = pages.select("page_id", F.posexplode(parts).alias("ord", "raw"))
    kind = F.when(F.col("raw").rlike("(?i)^<h[1-3]"), "heading").when(F.col("raw").rlike("(?i)^<blockquote"), "quote").otherwise("paragraph")
    text = F.regexp_replace(F.regexp_replace("raw", "(?i)<br\\s*/?>", "\n"), "(?s)<[^>]*>", "")
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    d = d.select("page_id", "ord", kind.alias("kind"), F.regexp_replace(text, "^\\s+|\\s+$", "").alias("text"))
    return d.where("text <> ''")


def resolve_sources(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """Documents with the path of the best root that has their file: ``listing(file, path, priority)``."""
    best = listing.groupBy("file").agg(F.min_by("path", "priority").alias("path"))
    return docs.join(best, "file", "left")


def load_event_rows(spark: SparkSession, path: str, keep: dict[str, str], expected: int | None = None) -> DataFrame:
    """Rows of a tab-separated UTF-16 table whose columns have the given values; the count is asserted."""
    rows = spark.read.csv(path, sep="\t", header=True, encoding="UTF-16", multiLine=True)
    for column, value in keep.items():
        rows = rows.where(F.col(column) == value)
    if expected is not None:
        found = rows.count()
        if found != expected:
            raise ValueError(f"{path}: {found} rows, expected {expected}")
    return rows


def upsert_docs(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``(doc, file, fresh)``: known files with their ids, unseen ones with ids after the largest.

    New ids follow the order of file names. Names are dealt to sampled ranges, numbered inside them and
    shifted by the ranges' sizes, so no task sorts all of them, whatever they begin with; the ranges
    are written, so that both readings see the same ones.
    """
    fresh = files.select("file").distinct().join(docs.select("file"), "file", "left_anti")
    ranged = checkpointed(fresh.repartitionByRange("file").withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy("file")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("shift", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "shift")
    largest = docs.agg(F.coalesce(F.max("doc"), F.lit(0)).alias("largest"))
    new = ranged.withColumn("n", F.row_number().over(w)).join(before, "part").join(F.broadcast(largest)).select((F.col("largest") + F.col("shift") + F.col("n")).alias("doc"), "file", F.lit(True).alias("fresh"))
    return docs.select("doc", "file", F.lit(False).alias("fresh")).unionByName(new)
