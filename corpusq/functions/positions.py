"""Match positions, spans over term groups, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusq.functions.text import let

#: Pieces of an array that are summed up in one go.
STRIDE = 64


def running_sums(sizes: Column) -> Column:
    """Sums of all elements before each place.

    Sums run inside strides and over the strides' totals, so the cost grows with the length and not
    with its square, as it does where every step copies the array.
    """
    def of(values: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRIDE).cast("int"))
        strides = F.transform(places, lambda p: F.slice(values, p * STRIDE + 1, F.lit(STRIDE)))
        grow = lambda acc, x: F.struct((acc.at + x).alias("at"), F.concat(acc.sums, F.array(acc.at)).alias("sums"))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("sums"))
        each = F.transform(strides, lambda s: F.aggregate(s, start, grow))
        whole = lambda e: F.aggregate(F.transform(e, lambda x: x.at), start, grow, lambda acc: acc.sums)
        shifted = lambda e, bases: F.zip_with(e, bases, lambda x, b: F.transform(x.sums, lambda v: v + b))
        return let(each, lambda e: let(whole(e), lambda bases: F.flatten(shifted(e, bases))))

    return let(sizes, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.expr("cast(array() as array<int>)")))


def match_positions(text: Column, pattern: Column | str) -> Column:
    """0-based code-point starts of all non-overlapping matches; the pattern must not match nothing."""
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)

    def starts(x: Column) -> Column:
        sizes = F.zip_with(x.gaps, x.hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        return F.zip_with(F.slice(x.gaps, 1, F.size(x.hits)), F.slice(running_sums(sizes), 1, F.size(x.hits)), lambda g, b: b + F.length(g))

    return F.when(text.isNotNull(), let(F.struct(F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("hits")), starts))


def group_mask(groups: Column) -> Column:
    """One bit for each group that has a position; at most 62 groups."""
    bits = F.transform(groups, lambda g, i: F.when(F.size(g) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)


def shortest_span(groups: Column) -> Column:
    """Length of the shortest window that holds a position of each group.

    0 for one group, null when a group is empty. Sweeps the positions in order and keeps the last
    one seen of each group.
    """
    marked = F.sort_array(F.flatten(F.transform(groups, lambda g, i: F.transform(g, lambda p: F.struct(p.alias("pos"), i.alias("group"))))))
    none = F.transform(groups, lambda g: F.lit(None).cast("int"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc.last, lambda p, i: F.when(i == x.group, x.pos).otherwise(p))
        width = F.when(F.forall(last, lambda p: p.isNotNull()), x.pos - F.array_min(last))
        return F.struct(last.alias("last"), F.least(acc.best, width).alias("best"))

    swept = F.aggregate(marked, F.struct(none.alias("last"), F.lit(None).cast("int").alias("best")), step)
    return F.when(F.size(groups) == 0, F.lit(None).cast("int")).otherwise(swept.best)


#: One sentence: text up to end marks and the closing quotes after them.
SENTENCE = "[^。！？!?…\\n]*[。！？!?…]+[」』”\")）》〉】]*|[^。！？!?…\\n]+"


def sentences(text: Column) -> Column:
    """array<struct<start, end, text>> of the sentences of a text, in order."""
    pieces = F.regexp_extract_all(text, F.lit("\\n|" + SENTENCE), F.lit(0))

    def placed(found: Column) -> Column:
        starts = running_sums(F.transform(found, lambda s: F.length(s)))
        rows = F.zip_with(found, starts, lambda s, at: F.struct(at.alias("start"), (at + F.length(s)).alias("end"), s.alias("text")))
        return F.filter(rows, lambda s: s.text != "\n")

    return let(pieces, placed)
