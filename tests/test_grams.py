"""Shared n-grams of all pairs, against sets; pairs of cards leave their task only when they pass."""

from __future__ import annotations

import random

import pytest

from corpusq.functions import grams
from corpusq.operators import glossary


def texts(seed, n):
    rng = random.Random(seed)
    pool = ["the", "ing", "and", "er", "远坂", "凛樱", "😀", "q", "zx", "0"]
    return ["".join(rng.choice(pool[: rng.randint(1, 10)]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def of(t):
    return {t[i : i + 3] for i in range(len(t) - 2)}


@pytest.mark.parametrize("sparse, columns, meetings", [(256, 2048, 1 << 20), (0, 5, 7), (1, 3, 1), (4, 16, 50), (1 << 40, 4, 1)])
def test_shared(monkeypatch, sparse, columns, meetings):
    """Counts by matrices, by single meetings and by both, in windows of any place."""
    for k, v in (("SPARSE", sparse), ("COLUMNS", columns), ("MEETINGS", meetings)):
        monkeypatch.setattr(grams, k, v)
    a, b = texts(1, 23), texts(2, 17)
    left, right = (grams.Grams([grams.trigrams(t) for t in x]) for x in (a, b))
    assert list(left.counts) == [len(of(t)) for t in a]
    windows = [(0, 23, 0, 17), (5, 9, 3, 17), (22, 23, 0, 1)]
    for (lo, hi, low, high), (i, j, m) in zip(windows, grams.shared(left, right, windows), strict=True):
        assert (i, j) == (lo, low) and m.tolist() == [[len(of(x) & of(y)) for y in b[low:high]] for x in a[lo:hi]]


@pytest.mark.parametrize("dealt", [(1024, 1 << 22), (3, 1 << 22), (1024, 200)])
def test_only_pairs_that_pass_leave_the_task(spark, monkeypatch, dealt):
    """Groups dealt by cards or by characters have the pairs of a plain reading, and no n-grams are joined to pairs."""
    monkeypatch.setattr(glossary, "DEALT", dealt[0])
    monkeypatch.setattr(glossary, "DEALT_TEXT", dealt[1])
    rng, rows = random.Random(3), []
    for t in texts(4, 12):
        for _ in range(3):
            rows.append((len(rows), "g" if len(rows) % 9 else "h", t[rng.randint(0, 4) :] + "the" * rng.randint(0, 25), "xy"[len(rows) % 2]))
    d = spark.createDataFrame(rows, "card_id long, group_id string, body string, bucket string")
    s = [(i, g, "".join(c for c in t if c.isalnum()), b) for i, g, t, b in rows]
    share = lambda x, y: len(of(x) & of(y))
    close = sorted((x[0], y[0], round(share(x[2], y[2]) / len(of(x[2]) | of(y[2])), 9)) for x in s for y in s if x[0] < y[0] and x[1] == y[1] and of(x[2]) and min(len(x[2]), len(y[2])) >= 0.85 * max(len(x[2]), len(y[2])) and share(x[2], y[2]) >= 0.7 * len(of(x[2]) | of(y[2])))
    found = glossary.duplicate_pairs(d)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in found.collect()) == close and len(close) > 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "array<bigint>" not in plan and "grams" not in plan
    long = sorted((x[0], y[0], len(x[2]), x[3] == y[3]) for x in s for y in s if x[1] == y[1] and len(x[2]) >= 40 and len(y[2]) >= 1.35 * len(x[2]) and share(x[2], y[2]) >= 0.7 * len(of(x[2])))
    assert sorted(tuple(r)[1:4] for r in glossary.coverage(d.drop("bucket")).collect()) == [x[:3] for x in long] and len(long) > 5
    assert sorted(tuple(r)[1:4] for r in glossary.coverage(d).collect()) == [x[:3] for x in long if x[3]]


def test_clusters_find_the_pairs_once(spark):
    """Pairs are as dear as a comparison of all cards: they are not found once for each direction."""
    from pyspark.sql import functions as F

    asked = spark.sparkContext.accumulator(0)

    def seen(a):
        asked.add(1)
        return a

    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long").withColumn("a", F.udf(seen, "long")("a"))
    got = glossary.clusters(spark.range(1, 10).withColumnRenamed("id", "card_id"), pairs)
    assert {r.card_id: r.cluster for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}
    assert asked.value == 3
