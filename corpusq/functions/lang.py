"""Script counts and language classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KANA, HAN = "[\\x{3040}-\\x{30ff}\\x{ff66}-\\x{ff9f}]", "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"
ACCENTED = "[à-öø-ÿœ]"
#: Share of kana among kana and han from which a line is Japanese.
JAPANESE_SHARE = 0.18


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def share_of(text: Column, part: str, whole: str) -> Column:
    """Characters of ``part`` over those of ``part`` and ``whole``, rounded to three places."""
    a, b = count_of(text, part), count_of(text, whole)
    return F.round(a / F.greatest(F.lit(1), a + b), 3)


def line_language(line: Column, part: str = KANA, whole: str = HAN, foreign: str = "ja", main: str = "zh", least: float = JAPANESE_SHARE) -> Column:
    """``foreign``, ``main``, "neutral", or null for a line without letters and digits.

    A line is foreign when the ``part`` characters reach their share; the defaults tell Japanese
    from Chinese by kana.
    """
    a, b = count_of(line, part), count_of(line, whole)
    empty = (a == 0) & (b == 0) & ~line.rlike("[A-Za-z0-9]")
    return F.when(empty, F.lit(None).cast("string")).when((a > 0) & (a / F.greatest(F.lit(1), a + b) >= least), foreign).when(b > 0, main).otherwise("neutral")
