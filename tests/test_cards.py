"""Near duplicates, coverage, pruning and order of cards against a plain reading with difflib."""

from __future__ import annotations

import difflib
import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pytest

from corpusq.functions import matching
from corpusq.operators import glossary
from corpusq.plans import catalog
from corpusq.plans import tables as tb

SF = "/root/testdata/sf0.001"


def blocks(a, b):
    return sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def skeleton(body):
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", re.sub(r"<[^>]*>", "", re.sub(r"https?://\S+", "", body or ""))))


def is_duplicate(a, b):
    short, long = sorted((a, b), key=len)
    return bool(a and b) and len(short) / len(long) >= 0.85 and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.70


def covers(short, long):
    return len(short) >= 40 and len(long) >= len(short) * 1.35 and blocks(short, long) / len(short) >= 0.70


def texts(rng, alphabet, n):
    """Random texts, and copies of one with changes, cuts and repeats."""
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    base, out = word(rng.randint(20, 160)), [word(rng.randint(0, 160)) for _ in range(n)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 40)):
            t[rng.randrange(len(t))] = rng.choice(alphabet)
        cut = rng.randint(0, 30)
        out.append("".join(t[cut:]) * rng.choice((1, 1, 1, 2)) + word(rng.choice((0, cut, 90))))
    return [base, *out]


ALPHABETS = ["ab", "abcdefgh", "远坂凛樱abc😀", ["the", "ing", "and", "er", "x"], "字"]


def test_matched_characters():
    """Every pair's characters in matching blocks, in both orders, for every bound."""
    rng = random.Random(11)
    for turn in range(60):
        all_texts = texts(rng, ALPHABETS[turn % 5], 8)
        x, shelf = matching.Text(all_texts[0]), matching.Shelf([matching.Text(t) for t in all_texts[1:]])
        left = np.array([rng.random() < 0.5 for _ in all_texts[1:]])
        true = [blocks(all_texts[0], t) if on else blocks(t, all_texts[0]) for t, on in zip(all_texts[1:], left)]
        least = np.array([rng.randint(0, m + 2) for m in true])
        assert shelf.matches(x, np.ones(len(true), bool), least, left) == {i: m for i, m in enumerate(true) if m >= least[i]}


def test_repeating_texts(monkeypatch):
    """Texts whose segments match too often are followed one by one; long common stretches are found whole."""
    monkeypatch.setattr(matching, "MOST_MATCHES", 50)
    pairs = [("xy" * 400, "xy" * 500), ("a" * 3000, "b" + "a" * 2000), ("abc" * 100 + "end", "end" + "abc" * 90)]
    for a, b in pairs:
        for limit in (50, 1 << 20):
            monkeypatch.setattr(matching, "MOST_MATCHES", limit)
            assert matching.Shelf([matching.Text(b)]).matches(matching.Text(a), np.ones(1, bool), np.zeros(1, int), np.ones(1, bool)) == {0: blocks(a, b)}


@pytest.fixture(scope="module")
def cards():
    rng = random.Random(5)
    rows = []
    for g, alphabet in enumerate(ALPHABETS):
        for t in texts(rng, alphabet, 9):
            rows.append((len(rows), f"g{g}" if len(rows) % 11 else "g0", t, len(rows) % 13 == 0, ("normal", "special", "other")[len(rows) % 3]))
    rows += [(len(rows), "lone", "alone", False, "other"), (len(rows) + 1, "g1", "", False, "other"), (len(rows) + 2, "g1", None, False, "normal"), (len(rows) + 3, "g1", " ,.", False, "normal")]
    return rows


@pytest.mark.parametrize("dealt", [(256, 1 << 19), (4, 1 << 19), (256, 300)])
def test_pairs_and_coverage(spark, cards, monkeypatch, dealt):
    """Whole groups and groups that are dealt by cards or by characters have the same pairs."""
    monkeypatch.setattr(glossary, "DEALT_CARDS", dealt[0])
    monkeypatch.setattr(glossary, "DEALT_CHARS", dealt[1])
    d = spark.createDataFrame(cards, "card_id long, group_id string, body string, forced boolean, bucket string")
    s = [(i, g, skeleton(t), b) for i, g, t, _, b in cards]
    expected = sorted((x[1], x[0], y[0], round(2 * blocks(x[2], y[2]) / (len(x[2]) + len(y[2])), 9)) for x in s for y in s if x[0] < y[0] and x[1] == y[1] and is_duplicate(x[2], y[2]))
    assert sorted((r.group_id, r.a, r.b, round(r.similarity, 9)) for r in glossary.matching_pairs(d).collect()) == expected and len(expected) > 20
    covered = sorted((x[1], x[0], y[0], len(x[2]), x[3] == y[3]) for x in s for y in s if x[1] == y[1] and covers(x[2], y[2]))
    assert sorted(tuple(r)[:4] for r in glossary.matching_coverage(d.drop("bucket")).collect()) == [c[:4] for c in covered] and len(covered) > 20
    assert sorted(tuple(r)[:4] for r in glossary.matching_coverage(d).collect()) == [c[:4] for c in covered if c[4]]


def test_close_pair_is_merged(spark):
    """A pair of ratio 0.885 that shares few n-grams."""
    a = "".join(chr(97 + i % 26) + chr(97 + (i * 7) % 26) for i in range(60))
    b = "".join(c if i % 9 else "0" for i, c in enumerate(a))
    assert 0.87 < difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() < 0.9
    d = spark.createDataFrame([(1, "g", a), (2, "g", b)], "card_id long, group_id string, body string")
    assert [(r.a, r.b) for r in glossary.matching_pairs(d).collect()] == [(1, 2)]


def test_queries_on_all_groups(spark):
    """The sample queries on the whole small table: pairs, clusters, coverage, pruning, order."""
    rows = tb.entries(spark, SF).collect()
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.card_id):
        groups[r.group_id].append((r, skeleton(r.body)))
    pairs, cover, root = set(), defaultdict(set), {r.card_id: r.card_id for r in rows}
    for g in groups.values():
        for k, (x, s) in enumerate(g):
            pairs |= {(x.card_id, y.card_id) for y, t in g[k + 1 :] if is_duplicate(s, t)}
            for y, t in g:
                if covers(s, t):
                    cover[x.card_id].add(y.card_id)
    ask = lambda name: catalog.QUERIES[name](spark, SF).collect()
    assert {(r.a, r.b) for r in ask("matching_duplicates")} == pairs and pairs
    assert {(r.short, r.long) for r in ask("matching_coverage")} == {(a, b) for a, bs in cover.items() for b in bs}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.card_id: r.cluster for r in ask("duplicate_clusters")} == root
    size = {r.card_id: len(s) for g in groups.values() for r, s in g}
    covered = defaultdict(list)
    for a, bs in cover.items():
        for b in bs:
            covered[b].append(size[a])

    def rank(r):
        return (len(re.sub(r"\s+", "", r.body)) < 40, -r.definition_quality, -len(r.body))

    def primary(r):
        c = covered[r.card_id]
        return (not r.forced, -len(c), -sum(c), {"normal": 0, "special": 1, "other": 2}[r.bucket], r.version if r.bucket != "other" else 0, not r.is_primary, rank(r), r.card_id)

    best = {}
    for r in rows:
        k = root[r.card_id]
        best[k] = min(best.get(k, r), r, key=primary)
    assert {(r.card_id, r.cluster) for r in ask("dedupe_cards")} == {(r.card_id, k) for k, r in best.items()}
    kept, placed = set(), set()
    for name, g in groups.items():
        for bucket in ("normal", "special", "other"):
            own = [(r, s) for r, s in g if r.bucket == bucket]
            ids = {r.card_id for r, _ in own}
            stay = [r.card_id for r, _ in own if r.forced or not cover[r.card_id] & ids]
            kept |= set(stay or [max(own, key=lambda x: (len(x[1]), -x[0].card_id))[0].card_id] if own else [])
        buckets = {r.bucket for r, _ in g}
        pool = [r for r, _ in g if r.bucket == "normal" or not {"normal", "special"} <= buckets]
        first = min(pool, key=primary)
        rest = sorted((r for r, _ in g if r is not first), key=lambda r: (primary(r)[1:3], {"special": 0, "normal": 1, "other": 2}[r.bucket], primary(r)[4:]))
        placed |= {(name, r.card_id, n + 1) for n, r in enumerate([first, *rest])}
    assert {r.card_id for r in ask("prune_covered")} == kept
    assert {(r.group_id, r.card_id, r.place) for r in ask("assemble_cards")} == placed


def test_bands_are_dealt_by_their_own_size(spark, monkeypatch):
    """A band of a large group is dealt over blocks of its own cards and the next band's, not of all cards of the group."""
    monkeypatch.setattr(glossary, "DEALT_CARDS", 10)
    rows = [(k, "g", "ab" * (50 if k % 2 else 500)) for k in range(120)]
    d = spark.createDataFrame(rows, "card_id long, group_id string, body string")
    sides = glossary._dealt_blocks(d, ["group_id"], glossary.DUPLICATE_LENGTHS)
    # Sixty cards a band are six blocks: a card is sent to six as left, six as right, six of the band before.
    assert sides.count() == 120 * 18 and {r.i for r in sides.select("i").distinct().collect()} == set(range(6))


def test_few_pairs_are_followed_alone(monkeypatch):
    """Unlike texts over one vocabulary are told apart together, by short stretches."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    short, *long = ["".join(rng.choice(words) for _ in range(n)) for n in [60, *range(120, 200)]]
    alone, true = [], [blocks(short, t) for t in long]
    follow = matching.matched
    monkeypatch.setattr(matching, "matched", lambda *a: alone.append(1) or follow(*a))
    least = np.full(len(long), int(0.8 * len(short)))
    found = matching.Shelf([matching.Text(t) for t in long]).matches(matching.Text(short), np.ones(len(long), bool), least, np.ones(len(long), bool))
    assert found == {i: m for i, m in enumerate(true) if m >= least[i]}
    assert len(alone) <= len(long) // 4


def test_few_queries_scan_bodies(spark, monkeypatch):
    """Few queries do not explode the grams of all bodies, and find what the join by grams finds."""
    from corpusq.operators import occurrences

    rows = [(1, "alpha", "The Beta of a·b"), (2, "beta", "no such word"), (3, "gamma", "betas and 远坂凛"), (4, "delta", "a b ab"), (5, "eps", None)]
    e = spark.createDataFrame(rows, "entry_id long, term string, body string")
    q = spark.createDataFrame([(1, "beta"), (2, "坂"), (3, "a·b"), (4, "beta"), (5, "a b")], "query_id long, q string")
    ask = lambda: sorted(tuple(r) for r in glossary.match_entries(q, e).collect())
    with monkeypatch.context() as m:
        m.setattr(occurrences, "FEW_TERMS", 0)
        joined = ask()
    monkeypatch.setattr(occurrences, "near_blocks", None)
    assert ask() == joined and (1, 1, "body") in joined and (2, 3, "body") in joined


@pytest.mark.parametrize("most", [2, 5])
def test_a_group_has_few_blocks(spark, monkeypatch, most):
    """A card of a large group is sent to as many block pairs as the group has blocks, not to one for every DEALT_CARDS cards; pairs stay the same."""
    rng = random.Random(7)
    bodies = [t for _ in range(6) for t in texts(rng, ALPHABETS[1], 8)] + ["abcdefgh" * 6] * 30 + ["hgfedcba" * 6] * 30
    rows = [(k, "g", t) for k, t in enumerate(bodies)]
    d = spark.createDataFrame(rows, "card_id long, group_id string, body string")
    close = sorted((i, j) for i, s in enumerate(bodies) for j in range(i + 1, len(bodies)) if is_duplicate(s, bodies[j]))
    long = sorted((i, j) for i, s in enumerate(bodies) for j, t in enumerate(bodies) if covers(s, t))
    monkeypatch.setattr(glossary, "DEALT_CARDS", 3)
    monkeypatch.setattr(glossary, "MOST_BLOCKS", most)
    assert sorted((r.a, r.b) for r in glossary.matching_pairs(d).collect()) == close and len(close) > 400
    assert sorted((r.short, r.long) for r in glossary.matching_coverage(d).collect()) == long and len(long) > 20

    def counted(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"group_id": [keys[0]], "a": keys[1], "b": keys[2], "n_a": sum(map(len, batches)), "n_b": 1, "matched": 1})

    monkeypatch.setattr(glossary, "_block_pairs", lambda measure, schema: counted)
    for found in (glossary.matching_pairs(d), glossary.matching_coverage(d)):
        assert found.count() <= most * (most + 1) // 2
