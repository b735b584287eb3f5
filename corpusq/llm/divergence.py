"""Quality rules with a distribution-divergence test against language references.

A document's histograms of character classes and of its language's commonest words are compared
with those of all documents of that language by Jensen-Shannon distance. Short documents have
unsteady histograms, so a guard exempts them and the limits are wider for them: that of the classes
by one over the root of the length, that of the words by the spread of a sample of that length. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from corpusq.llm.exprs import let
from corpusq.llm.scratch import materialize

SPACES = "[\\x20\\x09-\\x0D]+"
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Least words, and largest share of repeated words in per cent, of a document that may stay.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Words below which the divergence test says nothing.
GUARD_WORDS = 50
#: Common words of a language; languages whose words are literals of the scan. Those of others are joined, to
#: the same effect.
COMMON_WORDS, LANGUAGES = 24, 64
#: Limits of the Jensen-Shannon distance; the class limit grows by SLACK / 4 / sqrt(words).
MOST_CLASS, MOST_WORD, SLACK = 0.25, 0.30, 1.6
#: Standard deviations of a sample's squared word distance that are borne where they exceed MOST_WORD.
DEVIATIONS = 4.0
CLASSES = ("upper", "lower", "digit", "space", "symbol", "mark", "other")


def doc_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def _only(text: Column, keep: str) -> Column:
    """How many characters of the class ``keep`` are in the text."""
    return F.length(F.regexp_replace(text, f"[^{keep}]++", "")).cast("long")


def _class_counts(text: Column) -> Column:
    """array<long> of CLASSES. Most characters go in one sweep; the classes of the rest are counted on what is left."""
    counts = let(
        F.regexp_replace(text, "[a-z ]++", ""),
        lambda r: F.struct(
            _only(r, "A-Z").alias("upper"), _only(r, "0-9").alias("digit"), _only(r, "#*$%&|<>").alias("symbol"),
            _only(r, "!-\"'-)+-/:;=?@\\[-`{}~").alias("mark"), _only(r, "\\x80-\\x{10FFFF}").alias("other"),
        ),
    )
    both = F.struct(counts.alias("c"), _only(text, "\\x20\\x09-\\x0D").alias("space"), F.length(text).cast("long").alias("all"))
    return let(both, lambda x: F.array(x.c.upper, x["all"] - x.c.upper - x.c.digit - x.space - x.c.symbol - x.c.mark - x.c.other, x.c.digit, x.space, x.c.symbol, x.c.mark, x.c.other))


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of ``width`` words that the text holds twice or more.

    Windows are compared by 64-bit hash. Only texts with a repeated hash get their windows sorted
    with places.
    """

    def of(ws: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ws) - width)
        windows = lambda hs: F.transform(places, lambda i: F.xxhash64(*(F.get(hs, i + j) for j in range(width))))
        return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: let(windows(hs), covered))

    def covered(hashes: Column) -> Column:
        def marked(s: Column) -> Column:
            same = lambda i, x: F.coalesce(F.get(s, i).h == x.h, F.lit(False))
            hit = F.transform(s, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x.at))
            at = F.filter(hit, lambda p: p.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + (width - 1))))))

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, marked))

    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(words, of)).cast("long")


def _common_words(docs: DataFrame) -> tuple[dict[str, list[tuple[str, float]]], DataFrame | None]:
    """The commonest words of each language, with their shares of its words.

    Counted over all documents. Those of the LANGUAGES largest languages, rows of bounded width,
    reach the driver; those of others, if there are any, are a table ``(lang, word, share)``.
    """
    words = docs.select("lang", F.explode(doc_words(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = materialize(words, "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(LANGUAGES)
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    ranked = words.withColumn("r", F.row_number().over(top)).where(F.col("r") <= COMMON_WORDS)
    rows = total.join(ranked, "lang").groupBy("lang").agg(F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("share"))).alias("common")).collect()
    found = {r.lang: sorted((w.word, w.share) for w in r.common) for r in rows}
    if len(found) < LANGUAGES:
        return found, None
    others = words.where(~F.col("lang").isin(*found))
    if others.isEmpty():
        return found, None
    ranked = others.withColumn("r", F.row_number().over(top)).where(F.col("r") <= COMMON_WORDS)
    totals = others.groupBy("lang").agg(F.sum("n").alias("total"))
    return found, materialize(ranked.join(totals, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("share")), "common")


def _other_hits(docs: DataFrame, common: DataFrame) -> DataFrame:
    """``(row, other_hits, other_shares)``: how often the rows of ``docs``, told apart by ``row``, hold the words of ``common``."""
    listed = common.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("word", "share"))).alias("common"))
    words = docs.select("row", "lang", F.explode(doc_words(F.lower("text"))).alias("word"))
    times = words.join(common.select("lang", "word"), ["lang", "word"]).groupBy("row", "word").agg(F.count("*").alias("n"))
    held = times.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("held"))
    d = docs.select("row", "lang").join(listed, "lang").join(held, "row", "left")
    hits = F.transform("common", lambda c: F.coalesce(F.element_at("held", c.word), F.lit(0)).cast("int"))
    return d.select("row", hits.alias("other_hits"), F.transform("common", lambda c: c.share).alias("other_shares"))


def _class_shares(counted: DataFrame) -> DataFrame:
    """``(lang, reference)``: shares of the character classes of every language; one narrow row for each."""
    sums = counted.groupBy("lang").agg(*(F.sum(F.get("c", F.lit(i))).alias(c) for i, c in enumerate(CLASSES)))
    whole = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    return sums.select("lang", F.array(*(F.col(c) / F.greatest(F.lit(1), whole) for c in CLASSES)).alias("reference"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two histograms that each sum to one."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per document: counts, base verdict, distances and verdict.

    ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance, kept)``. A document fails the base with fewer than LEAST_WORDS
    words or more than MOST_REPEATED per cent repeated words. It is kept when it does not fail, and
    is short (GUARD_WORDS) or within both limits. Null and empty texts have no words and fail. The
    references come from all rows of ``docs``; without a language column all rows share one.
    Every row counts by itself, with a null or repeated id too; other columns are ignored; an empty
    table gives an empty one.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col and lang_col in docs.columns else F.lit("")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    text, lang = F.col("text"), F.col("lang")
    word_sets, others = _common_words(d)
    other_hits, row = None, F.lit(None).cast("long").alias("row")
    if others is not None:  # rows of further languages are written with a key of their own, by which their counts come back
        rest = materialize(d.where(~F.col("lang").isin(*word_sets)).withColumn("row", F.monotonically_increasing_id()), "rest")
        other_hits = _other_hits(rest, others)
        d = d.where(F.col("lang").isin(*word_sets)).withColumn("row", row).unionByName(rest)
    else:
        d = d.withColumn("row", row)
    every = sorted({w for v in word_sets.values() for w, _ in v})

    def counts(ws: Column) -> Column:
        hits = F.filter(F.transform(ws, lambda w: F.lower(w)), lambda w: w.isin(*every)) if every else F.expr("cast(array() as array<string>)")
        # Every hit stands between two spaces of its own, so a word is counted by what its removal takes off.
        spaced = F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" "))

        def by_language(h: Column) -> Column:
            branch = F.when(F.lit(False), F.expr("cast(null as array<int>)"))
            for k, v in word_sets.items():
                branch = branch.when(lang == k, F.array(*(((F.length(h) - F.length(F.replace(h, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int") for w, _ in v)))
            return branch

        return F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words"), let(spaced, by_language).alias("hits"))

    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select("doc_id", "lang", "row", let(doc_words(text), counts).alias("w"), _class_counts(text).alias("c"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    d = materialize(d.select("doc_id", "lang", "row", "w.*", "c", "n_dup_lines"), "counted")
    # Adaptive execution sends the references out while they are small, and else splits the rows of a large language.
    d = d.join(materialize(_class_shares(d), "references"), "lang")
    whole = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    class_distance = F.when(whole > 0, _distance(F.transform("c", lambda x: x / whole), F.col("reference")))
    word_shares = F.create_map(*(x for k, v in word_sets.items() for x in (F.lit(k), F.array(*(F.lit(s) for _, s in v))))) if word_sets else None
    total = F.aggregate("hits", F.lit(0), lambda a, x: a + x)
    with_rest = lambda a, rest: F.concat(a, F.array(rest))
    if other_hits is not None:
        known = d.where("row is null").withColumns({"other_hits": F.lit(None).cast("array<int>"), "other_shares": F.lit(None).cast("array<double>")})
        d = known.unionByName(d.where("row is not null").join(other_hits, "row", "left").select(*known.columns)).withColumn("hits", F.coalesce("hits", "other_hits"))
    if word_shares is None:
        word_distance = F.lit(None).cast("double")
    else:
        ref = F.element_at(word_shares, lang)
        if other_hits is not None:
            ref = F.coalesce("other_shares", F.try_element_at(word_shares, lang))
        word_distance = F.when(F.col("hits").isNotNull() & (F.col("n_words") > 0), _distance(with_rest(F.transform("hits", lambda x: x / F.col("n_words")), (F.col("n_words") - total) / F.col("n_words")), with_rest(ref, 1 - F.aggregate(ref, F.lit(0.0), lambda a, x: a + x))))
    d = d.select("doc_id", "n_words", (F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x) - F.get("c", F.lit(3))).alias("word_chars"), F.get("c", F.lit(4)).alias("n_symbols"), "n_dup_lines", "n_repeat_words", class_distance.alias("class_distance"), word_distance.alias("word_distance"), F.size("hits").alias("cells"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    slack = SLACK / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    # Of n words drawn from the reference, 8 ln 2 n times the squared distance is about chi-squared, a degree of freedom per common word.
    cells = F.greatest(F.coalesce("cells", F.lit(1)), F.lit(1)).cast("double")
    spread = F.sqrt((cells + DEVIATIONS * F.sqrt(2 * cells)) / (8 * math.log(2) * F.greatest(F.col("n_words"), F.lit(1))))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS + slack / 4) & (F.coalesce("word_distance", F.lit(0.0)) <= F.greatest(F.lit(MOST_WORD), spread))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ((F.col("n_words") < GUARD_WORDS) | near)).alias("kept"), "class_distance", "word_distance")
