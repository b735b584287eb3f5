"""Snippets around matches. Vectorised over the rows that a top-k has already chosen."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.functions import text as tx

#: Aimed-at and greatest lengths of sentence and paragraph snippets, in code points; a whole paragraph leaves room for two ellipses.
TARGET, HARD, PARAGRAPH_TARGET, PARAGRAPH_HARD, SHORT = 360, 600, 600, 800 - 2, 180
#: Empty places between two blocks that still follow each other.
BLANKS = 8
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("cut_before", T.BooleanType()), T.StructField("cut_after", T.BooleanType())])
SENTENCE = re.compile(r"\s*(?:[^。！？!?…\n\r]*[。！？!?…]+[」』”\")）)》〉】]*|[^。！？!?…\n\r]+)")
CLAUSE = re.compile(r"[，；：,;:。！？!?…\n\r]")


def sentence_list(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, white space around them left out."""
    out = []
    for m in SENTENCE.finditer(text):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if m[0].strip():
            out.append((start, start + len(m[0].strip())))
    return out


def _cut_long(text: str, start: int, end: int, hard: int) -> tuple[int, int]:
    """Of the match's line the widest stretch between clause marks that holds the match and fits; else ``hard`` characters around it.

    For every clause start the farthest mark within reach is looked up, so long lines cost no pairs.
    """
    low = 1 + max(text.rfind(c, 0, start) for c in "\n\r")
    high = min((at for c in "\n\r" if (at := text.find(c, start)) >= 0), default=len(text))
    if high - low <= hard:
        return low, high
    marks = [low, *(m.end() for m in CLAUSE.finditer(text, low, high))]
    marks += [high] if marks[-1] < high else []
    reach = [(a, marks[bisect_right(marks, a + hard) - 1]) for a in marks if a <= start]
    held = [(z - a, -a) for a, z in reach if z > end or z == high]
    if held:
        width, a = max(held)
        return -a, width - a
    a = min(max(low, start - max(0, hard - (end - start)) // 2), max(low, high - hard))
    return a, min(high, a + hard)


def sentence_window(text: str, start: int, end: int, target: int = TARGET, hard: int = HARD, around: int = 2) -> tuple[int, int]:
    """The matching sentence, then neighbours after and before while they fit ``target``."""
    spans = sentence_list(text)
    if not spans:
        return 0, 0
    first = max((i for i, (s, _) in enumerate(spans) if s <= start), default=0)
    last = min((i for i, (_, e) in enumerate(spans) if e >= end), default=len(spans) - 1)
    last = max(first, last)
    if spans[last][1] - spans[first][0] > hard:
        return _cut_long(text, start, end, hard)
    a, b = first, last
    while True:
        for side, i in (("after", b + 1), ("before", a - 1)):
            if not 0 <= i < len(spans) or (i - last if side == "after" else first - i) > around:
                continue
            low, high = spans[min(a, i)][0], spans[max(b, i)][1]
            if high - low <= target:
                a, b = min(a, i), max(b, i)
                break
        else:
            return spans[a][0], spans[b][1]


def block_window(text: str, start: int, end: int, hard: int = PARAGRAPH_HARD) -> tuple[int, int]:
    """The whole block when it fits, else sentences around the match."""
    return (0, len(text)) if len(text) <= hard else sentence_window(text, start, end, hard, hard, 100)


def paragraph_window(texts: list[str], at: int, start: int, end: int, places: list[int] | None = None) -> tuple[str, bool, bool]:
    """(snippet, cut before, cut after) in block ``at``; a short block takes neighbours, right first.

    Neighbours with more than BLANKS empty places between them, by ``places``, are not contiguous.
    """
    block = texts[at]
    places = list(range(len(texts))) if places is None else places
    if len(block) > PARAGRAPH_HARD:
        a, b = sentence_window(block, start, end, PARAGRAPH_HARD, PARAGRAPH_HARD, 100)
        return block[a:b], a > 0 or at > 0, b < len(block) or at + 1 < len(texts)
    left, right, prefer_right = at, at, True
    size = len(block)
    while size < SHORT:
        options = [(right + 1, right), (left - 1, left)]
        for i, edge in options if prefer_right else options[::-1]:
            if 0 <= i < len(texts) and abs(places[i] - places[edge]) <= BLANKS + 1 and size + 1 + len(texts[i]) <= PARAGRAPH_TARGET:
                prefer_right = i < left
                left, right, size = min(left, i), max(right, i), size + 1 + len(texts[i])
                break
        else:
            break
    return "\n".join(texts[left : right + 1]), left > 0, right + 1 < len(texts)


@F.pandas_udf(SPAN)
def sentence_snippet(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """Sentence window of each (text, match start, match end)."""
    return pd.DataFrame([sentence_window(t or "", int(a), int(b)) for t, a, b in zip(text, start, end)], columns=["start", "end"])


@F.pandas_udf(CUT)
def paragraph_snippet(texts: pd.Series, at: pd.Series, start: pd.Series, end: pd.Series, places: pd.Series) -> pd.DataFrame:
    """Paragraph window; ``texts`` and ``places`` hold the block and its neighbours, ``at`` its index among them."""
    return pd.DataFrame([paragraph_window(list(t), int(i), int(a), int(b), list(p)) for t, i, a, b, p in zip(texts, at, start, end, places)], columns=["text", "cut_before", "cut_after"])


def with_snippets(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """``hits(doc, ord, start, end, …)`` with ``snippet``: paragraph windows tidied to one line.

    A block carries the neighbours that its window can reach: while a window is shorter than SHORT it
    takes blocks that begin inside SHORT characters after its block, or end inside as many before it.
    So the places of blocks in their document, a running sum, tell how far to look, over any number of
    blocks; only documents with a hit are touched.
    """
    order = Window.partitionBy("doc").orderBy("ord")
    need = blocks.select("doc", "ord", "text").join(hits.select("doc").distinct(), "doc", "left_semi")
    placed = need.withColumns({"_start": F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.row_number().over(order), "_total": F.count("*").over(Window.partitionBy("doc"))})
    near = Window.partitionBy("doc").orderBy("_start")
    block = F.struct("ord", "text")
    # The last block that begins farther back may still end within reach.
    before = F.last(block).over(near.rangeBetween(Window.unboundedPreceding, -SHORT - 1))
    around = placed.withColumn("_blocks", F.concat(F.array_compact(F.array(before)), F.collect_list(block).over(near.rangeBetween(-SHORT, SHORT))))
    around = around.withColumn("_at", (F.array_position(F.transform("_blocks", lambda b: b.ord), F.col("ord")) - 1).cast("int"))
    left = F.col("_n") - 1 - F.col("_at")
    around = around.select("doc", "ord", "_blocks", "_at", (left > 0).alias("_before"), (left + F.size("_blocks") < F.col("_total")).alias("_after"))
    d = hits.join(around, ["doc", "ord"]).withColumn("_s", paragraph_snippet(F.col("_blocks.text"), "_at", "start", "end", F.col("_blocks.ord")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("_s.text", "(?i)<img[^>]*>", ""), "\\n", " "), " +", " "))
    cut_before, cut_after = F.col("_s.cut_before") | F.col("_before"), F.col("_s.cut_after") | F.col("_after")
    return d.withColumn("snippet", F.concat(F.when(cut_before, "…").otherwise(""), tidy, F.when(cut_after, "…").otherwise(""))).drop("_blocks", "_at", "_before", "_after", "_s")


def answer_excerpt(answer: Column, pattern: Column, longest: int = 420) -> Column:
    """struct(excerpt, truncated): the first matching line with two lines on each side, cut to ``longest``.

    Without a match the first four lines. Native: lines, the first match, a slice.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "\\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, pattern)), F.lit(True))
    low = F.greatest(F.lit(1), at - 2).cast("int")
    chosen = F.when(at > 0, F.slice(lines, low, F.least(F.size(lines), at.cast("int") + 2) - low + 1)).otherwise(F.slice(lines, 1, 4))
    whole = F.array_join(chosen, "\n")
    before, after = (at > 3), F.when(at > 0, at + 2 < F.size(lines)).otherwise(F.size(lines) > 4)
    cut = F.length(whole) > longest
    text = F.concat(F.when(before, "…").otherwise(""), F.substring(whole, 1, longest), F.when(after | cut, "…").otherwise(""))
    return F.struct(text.alias("excerpt"), (before | after | cut).alias("truncated"))


def text_snippet(text: Column, start: Column, width: int = 120) -> Column:
    """One line around a match of a single text, ``width`` characters on each side, with an ellipsis where it cuts."""
    low, high = F.greatest(F.lit(0), start - width), F.least(F.length(text), start + width)
    return tx.tidy_snippet(F.substring(text, low + 1, high - low), low > 0, high < F.length(text))
