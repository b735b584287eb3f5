"""License scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined by Spark to the places of the same
k-grams in license templates. A join row votes for its diagonal, document position minus template
position. Votes that follow each other on one diagonal are a segment; segments of neighbouring
diagonals that follow each other in the text (a few words inserted or left out) are merged to a span.
A span is verified word by word: the longest common subsequence of its words and the template's must
cover enough of both, all of a short template, and the span must not name other versions than the
template. Of spans that overlap, the one with most template words stays. A short list of
phrases gives base labels where their words stand consecutively.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.llm.exprs import let
from corpusq.llm.license_templates import TEMPLATES
from corpusq.llm.scratch import materialize

# Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Words of a k-gram; diagonals this close are merged, over gaps of so many words.
GRAM, NEAR, GAP = 3, 4, 12
#: Least share of a template's words in a span, and of a span's words in its template; least words of a template in a span.
LEAST_SHARE, LEAST_PURE, LEAST_WORDS = 0.5, 0.75, 5
#: Templates of fewer words must stand in a span whole: what tells them apart is a word or two.
WHOLE_WORDS = 15
VERSION = re.compile(r"\b(?:version|v) (\d+(?: \d+)*)")
WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def license_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null counts as empty."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, WORD_GAP, -1), lambda w: w != "")


def _template_grams(docs: DataFrame, k: int) -> DataFrame:
    """(gram, template, at) of every template; a fixed table, as many rows as the templates have words."""
    rows = []
    for number, (_, text) in enumerate(TEMPLATES):
        words = text.split(" ")
        rows += [(words[i : i + k], number, i) for i in range(len(words) - k + 1)]
    rows = docs.sparkSession.createDataFrame(rows, "words array<string>, template int, at int")
    return rows.select(F.xxhash64(*(F.get("words", F.lit(j)) for j in range(k))).alias("gram"), "template", "at")


def phrase_starts(words: Column, phrase: str) -> Column:
    """Positions at which the words of ``phrase`` stand consecutively."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        test = F.lit(True)
        for j, part in enumerate(parts):
            test = test & (F.get(words, i + j) == part)
        return test

    last = F.size(words) - len(parts)
    places = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    return F.filter(places, lambda i: (i <= last) & here(i))


def _versions(words: list[str]) -> set[str]:
    """Versions that are named; 2 0 is 2."""
    return {v.removesuffix(" 0") for v in VERSION.findall(" ".join(words))}


@F.pandas_udf(T.IntegerType())
def _common(words: pd.Series, template: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of a span's words and its template's, by bit rows; 0 where the span names other versions than the template."""
    sides = {t: TEMPLATES[t][1].split(" ") for t in template.unique()}
    versions = {t: _versions(sides[t]) for t in sides}

    def length(span: list[str], words: list[str]) -> int:
        at: dict[str, int] = {}
        for i, w in enumerate(words):
            at[w] = at.get(w, 0) | 1 << i
        row, full = (1 << len(words)) - 1, (1 << len(words)) - 1
        for w in span:
            hit = row & at.get(w, 0)
            row = (row + hit | row - hit) & full
        return len(words) - row.bit_count()

    named = [_versions(s) for s in words]
    return pd.Series([length(list(s), sides[t]) if not v or versions[t] <= v else 0 for s, t, v in zip(words, template, named)])


def _spans(scanned: DataFrame, k: int, near: int, least_share: float) -> DataFrame:
    """``(row, template, first, last, share, words)``: verified spans, ``words`` being those of the template."""
    template = _template_grams(scanned, k)
    votes = scanned.where("grams is not null").select("row", F.explode("grams").alias("g")).select("row", F.col("g.pos").alias("pos"), F.col("g.gram").alias("gram"))
    votes = votes.join(F.broadcast(template), "gram").select("row", "template", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    line = Window.partitionBy("row", "template", "diagonal").orderBy("pos")
    cut = F.when(F.col("pos") - F.lag("pos").over(line) <= GAP, 0).otherwise(1)
    segments = votes.withColumn("_part", F.sum(cut).over(line)).groupBy("row", "template", "diagonal", "_part").agg(F.min("pos").alias("first"), (F.max("pos") + k - 1).alias("last"))
    order = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when((F.col("first") - reach <= GAP) & (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= near), 0).otherwise(1)
    spans = segments.withColumn("_span", F.sum(fresh).over(order)).groupBy("row", "template", "_span").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    size = F.element_at(F.array(*(F.lit(len(t.split(" "))) for _, t in TEMPLATES)), F.col("template") + 1)
    spans = spans.withColumn("_size", size).where((F.col("last") - F.col("first") + 1).between(least_share * F.col("_size"), F.col("_size") / LEAST_PURE))
    spans = spans.join(scanned.where("grams is not null").select("row", F.col("words").alias("_words")), "row")
    spans = spans.withColumn("words", _common(F.expr("slice(_words, first + 1, last - first + 1)"), "template")).drop("_words", "_span")
    needed = F.when(F.col("_size") < WHOLE_WORDS, F.col("_size")).otherwise(least_share * F.col("_size"))
    good = (F.col("words") >= needed) & (F.col("words") >= LEAST_PURE * (F.col("last") - F.col("first") + 1)) & (F.col("words") >= F.least(F.lit(LEAST_WORDS), F.col("_size")))
    return spans.where(good).select("row", "template", "first", "last", (F.col("words") / F.col("_size")).alias("share"), "words")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, near: int = NEAR, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per document: words, base places and labels, spans found by diagonal voting.

    ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``: spans is
    an array of (label, first, last, share) with word positions, share being the part of a template's
    words that stand in order in the span, which must reach ``least_share``, or all of a template under
    WHOLE_WORDS; a span that names versions must name those of the template. ``labels`` joins the
    labels of base places and spans; ``score`` is the largest share, 1 where a phrase stands. Null and
    empty texts have no words and no labels. Rows are told apart by themselves, so null and repeated
    ids keep their own spans; other columns are ignored; an empty table gives an empty one. Each text
    is cut into words once, and only rows with k-grams of a template keep theirs.
    """
    known = [r.gram for r in _template_grams(docs, k).select("gram").distinct().collect()]  # as many as the templates have words

    def scan(words: Column) -> Column:
        base = F.array(*(F.struct(phrase_starts(words, p).alias("places"), F.lit(label).alias("label")) for p, label in PHRASES))
        rolling = F.transform(words, lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k))).alias("gram")))
        grams = F.filter(rolling, lambda g: g.gram.isin(known))
        return let(F.struct(base.alias("base"), grams.alias("grams")), lambda x: F.struct(
            F.size(words).cast("long").alias("n_words"), F.flatten(F.transform(x.base, lambda b: b.places)).alias("places"),
            F.array_sort(F.array_distinct(F.transform(F.filter(x.base, lambda b: F.size(b.places) > 0), lambda b: b.label))).alias("base_list"),
            F.when(F.size(x.grams) > 0, x.grams).alias("grams"), F.when(F.size(x.grams) > 0, words).alias("words"),
        ))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), let(license_words(F.col(text_col)), scan).alias("x"))
    d = materialize(d.select("doc_id", "row", "x.*"), "licenses")
    spans = materialize(_spans(d, k, near, least_share), "spans")
    other = spans.select("row", *(F.col(c).alias(f"_{c}") for c in ("template", "first", "last", "share", "words")))
    better = (F.col("_words") > F.col("words")) | ((F.col("_words") == F.col("words")) & ((F.col("_share") > F.col("share")) | ((F.col("_share") == F.col("share")) & (F.col("_template") < F.col("template")))))
    beaten = spans.join(other, "row").where((F.col("_first") <= F.col("last")) & (F.col("first") <= F.col("_last")) & (F.col("_template") != F.col("template")) & better)
    spans = spans.join(beaten.select("row", "template", "first", "last").distinct(), ["row", "template", "first", "last"], "left_anti")
    label = F.element_at(F.array(*(F.lit(x) for x, _ in TEMPLATES)), F.col("template") + 1)
    found = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(label.alias("label"), "first", "last", "share"))).alias("spans"))
    out = d.drop("grams", "words").join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base_list", F.coalesce(F.transform("spans", lambda s: s.label), F.array().cast("array<string>")))))
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_list", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(share).alias("score"), "spans",
    )
