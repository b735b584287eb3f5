"""Steps of searches that once made what nothing asked for, or made it several times."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest

from corpusq.operators import multiterm, occurrences, search, suggest


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def units(spark):
    b = spark.createDataFrame([(1, 0, "the ox and the cow"), (1, 1, "the ox"), (2, 0, "cow and ox, the"), (3, 0, "the end")], "doc long, ord int, text string")
    g = spark.createDataFrame([(1, 0, "the"), (1, 1, "ox"), (1, 2, "cow"), (2, 0, "end"), (2, 1, "none")], "query_id long, `group` int, term string")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc long, work string")
    return multiterm.match_units(g, b), docs


def test_statistics_of_units_need_no_positions(spark):
    """Of each query the highest level counts, from one scan that finds no positions."""
    u, docs = units(spark)
    stats = multiterm.unit_stats(u, docs)
    assert {(r.query_id, r.work, r.units, r.docs) for r in stats.collect()} == {(1, "a", 1, 1), (1, "b", 1, 1), (1, None, 2, 2), (2, "b", 1, 1), (2, None, 1, 1)}
    assert "split(" not in plan(stats) and plan(stats).count("regexp_extract_all") == plan(multiterm.effective_level(u)).count("regexp_extract_all") > 0


def test_listings_of_units_scan_once(spark):
    u, docs = units(spark)
    page = search.list_units(u, docs, 0, 1)
    assert rows(page, "query_id", "doc", "ord", "rank", "total", "has_more") == [(1, 1, 0, 1, 2, True), (2, 3, 0, 1, 1, False)]
    assert "regexp_extract_all" not in plan(page)


def test_only_the_kinds_of_grams_that_terms_ask_for_are_made(spark, monkeypatch):
    made, kept = [], occurrences.block_grams
    monkeypatch.setattr(occurrences, "block_grams", lambda blocks, *kinds: made.append(kinds) or kept(blocks, *kinds))
    b = spark.createDataFrame([(1, 0, "foo bar 12"), (2, 0, "远坂 and 123"), (3, 0, "bar foo")], "doc long, ord int, text string")
    for terms, kinds, docs in ((["foo"], (False, False), [1, 3]), (["foo bar"], (True, False), [1]), (["远坂"], (False, True), [2]), (["12", "and"], (False, True), [1, 2, 2]), (["zzz"], (False, False), [])):
        t = spark.createDataFrame(list(enumerate(terms)), "query_id long, term string")
        hits = occurrences.index_occurrences(t, b, positions=False)
        assert made.pop() == kinds and [d for d, in rows(hits, "doc")] == docs
    assert occurrences.near_blocks(spark.createDataFrame([], "query_id long, term string"), b).count() == 0


def test_stretches_are_counted_from_the_left_in_time_that_grows_with_the_block(spark):
    """A block of a quarter of a million characters took minutes, as each of its places was looked for from the start."""
    texts = ["aaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabc", "𝒳abcdefgh𝒳abcdefgh", "?abcdefgh short", "line one\ncrossed line one\ncrossed", "", "éàü" * 80_000 + "abcdefgh"]
    parts = ["aaaaaaaa", "aaaaaaaaa", "abcabcabc", "abcdefgh", "?abcdefg", "𝒳abcdefg", "line one\ncrossed", "éàüéàüéàü", "not there"]
    b = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)] + [(99, 0, None)], "doc long, ord int, text string")
    p = spark.createDataFrame([(x,) for x in parts + parts[:2]], "part string")
    began = time.monotonic()
    assert rows(suggest.stretches_in(p, b), "part", "n") == sorted((x, n) for x in parts if (n := sum(t.count(x) for t in texts)))
    assert time.monotonic() - began < 60


def test_hits_and_cards_of_a_search_are_found_once(spark):
    """Sections read stored hits and cards; no plan of theirs scans blocks or bodies again."""
    b = spark.createDataFrame([(1, 0, "the ox"), (2, 0, "der ox, the der")], "doc long, ord int, text string")
    v = spark.createDataFrame([(1, "the"), (2, "der"), (2, "the")], "query_id long, term string")
    hits = search.variant_hits(v, b)
    assert rows(hits, "query_id", "doc", "ord", "n") == [(1, 1, 0, 1), (1, 2, 0, 1), (2, 1, 0, 1), (2, 2, 0, 3)]
    assert plan(hits).count("regexp_extract_all") == 1  # of blocks with several variants alone


def test_many_latin_terms_are_counted_where_blocks_lie(spark, monkeypatch):
    """Terms of Latin words are sent to the blocks in shares; no block and no hit is shuffled, and the rows are those of one scan."""
    texts = [f"the w{i} and the·w{i + 1} or thew{i + 2}, THE w{i}" for i in range(30)] + ["a b c", "ab c", "a bc ab c", "abc", "远坂 w1", None]
    b = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, ord int, text string")
    t = spark.createDataFrame([(i, f"the w{i}") for i in range(30)] + [(50, "a b c"), (51, "w1 远坂"), (52, "远坂"), (53, "w3, the"), (54, " "), (55, "the w1")], "query_id long, term string")
    cols = ["query_id", "term", "doc", "ord", "n", "positions"]
    true = rows(occurrences.scan_occurrences(t, b), *cols)
    for grams in (100_000, 9):
        monkeypatch.setattr(occurrences, "SENT_GRAMS", grams)
        assert rows(occurrences.many_occurrences(t, b), *cols) == true and len(true) > 80
    hits = occurrences.many_occurrences(t.where("query_id < 50"), b, positions=False)
    assert rows(hits, *cols[:5]) == [r[:5] for r in true if r[0] < 50]
    assert not re.search(r"Exchange hashpartitioning\((doc|ord)#", hits._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("limits", [(1 << 21, 1 << 22, 500), (5, 7, 3)])
def test_pairs_of_terms_are_summed_before_they_are_sent(spark, monkeypatch, limits):
    """Terms that share the most blocks, ties by name, against a plain count; a block's hits are not joined with themselves."""
    rng = random.Random(2)
    for k, v in zip(("LISTED", "HELD", "SHARE"), limits):
        monkeypatch.setattr(suggest, k, v)
    words = [f"t{i}" for i in range(20)]
    held = {(d, o): {w for w in words if rng.random() < 0.3} for d in range(25) for o in range(2)}
    hits = spark.createDataFrame([(w, d, o) for (d, o), ws in held.items() for w in ws for _ in range(rng.randint(1, 2))], "term string, doc long, ord int")
    blocks = spark.createDataFrame([(d, o, " ".join(sorted(ws)).upper() + " t3 other") for (d, o), ws in held.items()], "doc long, ord int, text string")
    terms = spark.createDataFrame([(w,) for w in [*words, "never"]], "term string")
    for given, sets in ((hits, held), (None, {k: ws | {"t3"} for k, ws in held.items()})):
        n = Counter((a, b) for ws in sets.values() for a in ws for b in ws if a != b)
        best = sorted((a, b, c, p) for a in words for p, (c, b) in enumerate(sorted((-c, b) for (x, b), c in n.items() if x == a)[:4], 1) for c in [-c])
        got = suggest.related_terms(blocks, terms, 4, given)
        assert rows(got, "term", "other", "n", "place") == best
        assert not re.search(r"Join \[(doc|ord)#", got._jdf.queryExecution().executedPlan().toString())
