"""Secret scan: known shapes by pattern, unknown ones by a battery of randomness tests.

Runs of encoding characters outside the known shapes get an inferred encoding (hex, base32, lower-case
letters, letters, base62, base64). Three tests compare the run with a uniform draw from the
encoding's alphabet: chi-squared of the character counts, by way of the number of pairs of equal
characters, which it is a linear function of; runs above and below the middle of the alphabet; and
lag-one serial correlation. Fisher's method joins them. The number of equal pairs is also compared
with what written text of the same length would give, which is the null hypothesis of a discovery.
Weighted Benjamini-Hochberg over all runs of the corpus, with weights by length, controls the share
of false discoveries. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.exprs import let, match_spans
from corpusq.llm.scratch import materialize

# Patterns of the known kinds; a match must reach the length given in code points.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
#: Runs that are tested, whole and between separators. Shorter ones can't be told from text by any of the tests.
WHOLE, PART = r"[A-Za-z0-9+/_-]{20,}={0,2}", r"[A-Za-z0-9]{20,}"
# Alphabets in the order of their codes.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Chances that two and that three characters of written text are equal.
TEXT_PAIR, TEXT_TRIPLE = 0.066, 0.0056
#: Share of false discoveries; least combined p-value of the uniform tests; length of weight one.
FDR, LEAST_UNIFORM, LENGTH_OF_WEIGHT_ONE = 0.01, 0.001, 32
#: Bins of -log2(p) for the corpus-wide step-up, eight to the bit.
BINS = 800


# A rational Chebyshev fit of the complementary error function, whose relative error is under 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _above(z: Column) -> Column:
    """Chance that a standard normal value exceeds z, right in the far tails too."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    fit = F.lit(0.0)
    for c in reversed(ERFC):
        fit = fit * t + c
    tail = 0.5 * t * F.exp(fit - x * x)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _tests(run: Column) -> Column:
    """struct(encoding, size, p_text, p_uniform) of one run of encoding characters."""
    body = F.regexp_replace(run, "=+$", "")
    shapes = {"hex": "^([0-9a-f]+|[0-9A-F]+)$", "base32": "^[A-Z2-7]+$", "lower": "^[a-z]+$", "letters": "^[A-Za-z]+$", "base62": "^[A-Za-z0-9]+$"}

    def by_encoding(enc: Column, value: Callable[[str], object]) -> Column:
        first, *others = shapes
        out = F.when(enc == first, value(first))
        for name in others:
            out = out.when(enc == name, value(name))
        return out.otherwise(value("base64"))

    name = F.lit("base64")
    for shape, pattern in reversed(shapes.items()):
        name = F.when(body.rlike(pattern), shape).otherwise(name)

    def battery(x: Column) -> Column:
        n = F.length(x.body).cast("double")
        k = by_encoding(x.enc, lambda e: float(len(ALPHABETS[e])))
        alphabet = by_encoding(x.enc, lambda e: ALPHABETS[e])
        plain = F.when(x.enc == "hex", F.lower(x.body)).otherwise(F.translate(x.body, "-_", "+/"))
        chars = F.filter(F.split(plain, ""), lambda c: c != "")
        squares = let(chars, lambda cs: _sum(F.transform(F.array_distinct(cs), lambda c: F.pow(F.size(F.filter(cs, lambda y: y == c)).cast("double"), F.lit(2.0)))))
        values = F.transform(chars, lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        middle = (k - 1) / 2
        swings = let(values, lambda v: _sum(F.transform(v, lambda y, i: F.when((i > 0) & ((y > middle) != (F.get(v, i - 1) > middle)), 1.0).otherwise(0.0))))
        serial = let(values, lambda v: let(_sum(v) / n, lambda mean: _sum(F.transform(v, lambda y, i: F.when(i > 0, (y - mean) * (F.get(v, i - 1) - mean)).otherwise(0.0))) / F.greatest(F.lit(1e-9), _sum(F.transform(v, lambda y: (y - mean) * (y - mean))))))
        stats = F.struct(((squares - n) / 2).alias("pairs"), swings.alias("swings"), serial.alias("serial"), n.alias("n"), k.alias("k"))

        def tests(s: Column) -> Column:
            all_pairs = s.n * (s.n - 1) / 2
            gamma = lambda x, mean, shape: (F.pow(F.greatest(F.lit(0.0), x) / mean, F.lit(1 / 3)) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape)
            # Pairs are about gamma distributed with the moments of a multinomial; normal scores by the cube root.
            uniform = gamma(s.pairs - 0.5, all_pairs / s.k, all_pairs / (s.k - 1))
            # Of texts drawn by the letters' frequencies fewer have so few pairs than the gamma tail says, so it errs towards text.
            mean = all_pairs * TEXT_PAIR
            spread = all_pairs * (TEXT_PAIR - TEXT_PAIR**2) + s.n * (s.n - 1) * (s.n - 2) * (TEXT_TRIPLE - TEXT_PAIR**2)
            as_text = gamma(s.pairs + 0.5, mean, mean * mean / spread)
            runs = (2 * s.swings - (s.n - 1)) / F.sqrt(s.n - 1)
            ps = (_above(uniform), 2 * _above(F.abs(runs)), 2 * _above(F.abs(s.serial * F.sqrt(s.n))))
            half = -sum((F.log(F.greatest(p, F.lit(1e-15))) for p in ps), F.lit(0.0))
            joint = F.exp(-half) * (1 + half + half * half / 2)
            return F.struct(x.enc.alias("encoding"), F.length(x.body).alias("size"), F.greatest(_above(-as_text), F.lit(1e-30)).alias("p_text"), joint.alias("p_uniform"))

        return let(stats, tests)

    return let(F.struct(name.alias("enc"), body.alias("body")), battery)


SPANS = "array<struct<start:int,end:int,rank:int,kind:string>>"


def _base(text: Column) -> Column:
    """Spans of the known kinds by start, then kind as listed."""

    def spans(kind: str, rank: int, pattern: str, least: int = 0) -> Column:
        found = match_spans(text, pattern, (0, 2) if least else (0,))
        if least:
            found = F.filter(found, lambda x: F.length(x.g1) >= least)
        shaped = F.transform(found, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))
        return F.when(text.rlike(pattern), shaped).otherwise(F.expr(f"cast(array() as {SPANS})"))

    return F.array_sort(F.concat(spans("assign", 0, ASSIGN, ASSIGN_LEAST), spans("access", 1, ACCESS), spans("hex", 2, HEX)))


def _covered(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, so that what touches them stands alone."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.when(x.end <= acc.at, acc).otherwise(
        F.struct(x.end.alias("at"), F.concat(acc.out, F.substring(text, acc.at + 1, F.greatest(F.lit(0), x.start - acc.at)), F.repeat(F.lit(" "), x.end - F.greatest(x.start, acc.at))).alias("out"))
    )
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _runs(text: Column) -> Column:
    """Runs of WHOLE and of PART, each place once; runs of digits alone are numbers and are not tested."""
    found = lambda p: F.transform(match_spans(text, p), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.g0.alias("g0")))
    both = F.filter(F.array_distinct(F.concat(found(WHOLE), found(PART))), lambda x: x.g0.rlike("[A-Za-z]"))
    return F.when(text.rlike(WHOLE), both).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,g0:string>>)"))


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``base`` and ``runs``; runs are tested and lie apart from base spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.withColumn("base", _base(text)).withColumn("_open", _covered(text, F.col("base")))
    d = d.withColumn("runs", _runs(F.col("_open"))).drop("_open")
    return d.withColumn("runs", F.transform("runs", lambda r: F.struct(r.start.alias("start"), r.end.alias("end"), _tests(r.g0).alias("t"))))


def _weight(size: Column) -> Column:
    """Longer runs separate written text from random draws better, and get more of the error budget."""
    return F.least(F.lit(4.0), F.pow(size / float(LENGTH_OF_WEIGHT_ONE), F.lit(2.0)))


def _threshold(runs: DataFrame, fdr: float) -> float:
    """Largest weighted p-value that the step-up procedure accepts, from counts of BINS bins."""
    t = runs.select(_weight(F.col("t.size")).alias("w"), F.col("t.p_text").alias("p"))
    b = F.least(F.lit(BINS - 1), F.floor(-F.log2(F.least(F.lit(1.0), F.col("p") / F.col("w"))) * 8)).cast("int")
    counts = t.select(b.alias("b"), "w").groupBy("b").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()  # BINS rows at most
    total, mean = sum(r.n for r in counts), sum(r.w for r in counts)
    best, seen = 0.0, 0
    for r in sorted(counts, key=lambda r: -r.b):
        seen += r.n
        upper = 2.0 ** (-r.b / 8)
        if upper * mean / total <= fdr * seen / total:
            best = upper
    return best


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``(doc_id, base, added)``, one row per document.

    ``base`` and ``added`` are arrays of (start, end, rank, kind) in code points, end exclusive:
    kinds assign, access and hex by pattern, kind random by the test battery. Null and empty texts
    have no spans; null and repeated ids give rows of their own; other columns are ignored; an empty
    table gives an empty one.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = materialize(_scanned(d, "text").drop("text"), "secrets")
    cut = _threshold(d.select(F.explode("runs").alias("r")).select("r.t"), fdr)
    return d.select("doc_id", "base", _added(cut).alias("added"))


def _added(cut: float) -> Column:
    """The runs that are discoveries at a weighted p-value, and that no uniform test rejects; a part gives way to a whole run."""
    passed = F.filter("runs", lambda r: (r.t.p_text / _weight(r.t["size"]) <= cut) & (r.t.p_uniform >= LEAST_UNIFORM))
    outer = let(passed, lambda ps: F.filter(ps, lambda r: ~F.exists(ps, lambda o: (o.start <= r.start) & (o.end >= r.end) & (o.end - o.start > r.end - r.start))))
    return F.transform(outer, lambda r: F.struct(r.start.alias("start"), r.end.alias("end"), F.lit(3).alias("rank"), F.lit("random").alias("kind")))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.rank.alias("rank"), x.end.alias("end"), x.kind.alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; of overlapping spans one mask stands.

    Rows without spans are unchanged, null texts stay null, columns and their order stay. The texts
    are scanned twice, for the corpus-wide threshold and for the spans, and are never shuffled.
    """
    runs = _scanned(docs.select(F.col(text_col).alias("text")), "text").select(F.explode("runs").alias("r")).select("r.t")
    cut = _threshold(materialize(runs, "runs"), fdr)
    d = _scanned(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), "text")
    d = d.select("row", "text", F.array_sort(F.transform(F.concat("base", _added(cut)), lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))).alias("spans"))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.when(x.end <= acc.at, acc).otherwise(
        F.struct(x.end.alias("at"), F.concat(acc.out, F.when(x.start >= acc.at, F.concat(F.substring(text, acc.at + 1, x.start - acc.at), F.lit(mask))).otherwise(F.lit(""))).alias("out"))
    )
    cleaned = F.aggregate("spans", start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    cleaned = F.when(F.size("spans") > 0, cleaned).otherwise(text)
    return d.select(*(cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
