"""Small builders for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusq.functions.positions import running_sums


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, g0, ...>>, in code points.

    ``split`` and ``regexp_extract_all`` find the same matches, so the pieces between them give
    the places. The pattern must not match the empty string.
    """
    p = F.lit(pattern)
    names = [f"g{i}" for i in range(len(groups))]
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), *(F.regexp_extract_all(text, p, F.lit(g)).alias(n) for g, n in zip(groups, names)))

    def placed(x: Column) -> Column:
        n = F.size(x.g0)
        sums = running_sums(F.zip_with(x.gaps, x.g0, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))))
        starts = F.zip_with(F.slice(x.gaps, 1, n), F.slice(sums, 1, n), lambda g, at: at + F.length(g))
        zipped = F.arrays_zip(starts.alias("start"), *(x[c].alias(c) for c in names))
        return F.transform(zipped, lambda m: F.struct(m.start.alias("start"), (m.start + F.length(m.g0)).alias("end"), *(m[c].alias(c) for c in names)))

    return let(found, placed)
