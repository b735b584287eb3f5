"""Filter audit, vector codes and source mix on awkward tables, and against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.llm import code_grid, filter_audit, queries, source_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} and" for i in range(20000))
CLASH = ["1 AS part", "2 AS mask", "3 AS n", "4 AS good", "5 AS step", "6 AS size", "7 AS start", "8 AS slot", "9 AS code", "10 AS error", "11 AS quality", "12 AS same"]
TEXTS = [None, "", " \n\t", "one", "A B C", "a $ b", "Straße 😀 ▁x", "same text", "same text", LONG, LONG + " END#", "x" * 5000, "AB " * 300, "same text"]
OUT = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
SQL_TABLES = ("documents", "embeddings", "labels")


def documents(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.selectExpr("*", *CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None) for i, t in enumerate(TEXTS)]
    return documents(spark, [*rows, (8, "same text", "de", "t"), (None, "same text", "de", "t"), (None, None, None, None), (8, "same text", "de", "t")]).cache()


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(8, 1, 0), (8, 0, 1), (9, 1, None), (None, 1, 1), (12, 0, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")


# 11


def brute_audit(docs, labels):
    rows = [(r.doc_id, r.text or "", r.lang or "") for r in docs.collect()]
    marks = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    good, bad = {i for i, q, _ in marks if q == 1} - {None}, {i for i, _, t in marks if t == 1} - {None}
    found = []
    for i, t, part in rows:
        w = WORD.findall(t)
        fails = {c for c, x in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)]) if x}
        found.append((part, fails, i in good, i in bad))
    out = {}
    for part in {f[0] for f in found}:
        own, shapley = [f for f in found if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                before = set(order[:k])
                gone = [f for f in own if c in f[1] and not f[1] & before]
                shapley[c] += len(gone)
                out[part, "".join(order), k + 1] = [sum(not f[1] & {*before, c} for f in own), len(gone), sum(c in f[1] and bool(f[1] & before) for f in own), sum(f[1] == {c} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_brute_force(docs, marks):
    got = {(r.part, r.filter_order, r.step): [r[c] for c in OUT] for r in filter_audit.audit(filter_audit.failures(docs, marks)).collect()}
    assert got == brute_audit(docs, marks) and len(got) == 3 * 600


def test_audit_empty(docs, marks):
    assert filter_audit.audit(filter_audit.failures(docs.limit(0), marks)).count() == 0
    none = filter_audit.audit(filter_audit.failures(docs, marks.limit(0)))
    assert none.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_audit_other_filters(spark):
    """Any letters; many parts pass the session's limit of recursion rows."""
    cells = spark.range(40).select(F.concat(F.lit("p"), "id").alias("part"), F.explode(F.array(F.lit(1), F.lit(3))).alias("mask"), F.lit(2).cast("long").alias("n"), F.lit(1).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    spark.conf.set(filter_audit.ROW_LIMIT, "20")
    try:
        rows = filter_audit.audit(cells, "XY").where("part = 'p7'").collect()
        assert spark.conf.get(filter_audit.ROW_LIMIT) == "20"
    finally:
        spark.conf.unset(filter_audit.ROW_LIMIT)
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in rows) == [("XY", 1, 0, 4, 0, 2, 6), ("XY", 2, 0, 0, 2, 0, 2), ("YX", 1, 2, 2, 0, 0, 2), ("YX", 2, 0, 2, 2, 2, 6)]


# 12


def brute_codes(rows, entries=256, rounds=4):
    """Plain k-means on all distances: ({(id, code, error): times}, label errors, digest)."""
    v = np.array([r[1] for r in rows], np.float64)
    v = np.floor(v * 1024).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, v[i].tolist()))
    dim = v.shape[1]
    edge = [dim * p // 4 for p in range(5)]
    books = [v[order[:entries], a:b].copy() for a, b in zip(edge, edge[1:])]
    for turn in range(rounds + 1):
        far = [((v[:, None, a:b] - e[None]) ** 2).sum(2) for e, a, b in zip(books, edge, edge[1:])]
        codes = [d.argmin(1) for d in far]
        if turn < rounds:
            for e, c, a, b in zip(books, codes, edge, edge[1:]):
                for k in set(c.tolist()):
                    e[k] = v[c == k, a:b].sum(0) // (c == k).sum()
    error = sum(d.min(1) for d in far)
    text = ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(rows))]
    by_label = Counter()
    for r, e in zip(rows, error):
        by_label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], c, int(e), by_label[r[2]]) for r, c, e in zip(rows, text, error)), digest


def codes_of(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", *CLASH)
    codes, books = code_grid.compress(d)
    return Counter(map(tuple, code_grid.with_label_errors(codes).select("vec_id", "code", "error", "label_error").collect())), code_grid.codebooks_sha256(books), books


def vectors(n, dim, seed, spread=0.2):
    return np.random.default_rng(seed).normal(0, spread, (n, dim)).astype(np.float32).tolist()


@pytest.mark.parametrize("n,dim,spread", [(700, 16, 0.2), (700, 8, 0.003), (90, 12, 5.0), (1, 4, 1.0), (400, 10, 0.2), (300, 2, 0.1)])
def test_codes_brute_force(spark, n, dim, spread):
    """Many ties at a small spread, fewer rows than entries, lengths that four does not divide."""
    rows = [(i * 7 % (n + 1), x, None if i % 5 == 0 else i % 3) for i, x in enumerate(vectors(n, dim, n + dim, spread))]
    got, digest, _ = codes_of(spark, rows)
    assert (got, digest) == brute_codes(rows)


def test_codes_awkward_rows(spark):
    """Nulls, NaN and infinities and other lengths go; null and repeated ids and repeated vectors stay."""
    x = vectors(300, 8, 3)
    sound = [(i // 2 if i < 20 else i, v, 1) for i, v in enumerate(x)] + [(None, x[0], None), (None, x[5], 2)] + [(1000 + i, x[7], 9) for i in range(50)]
    bad = [(-1, None, 1), (-2, [None] + x[0][1:], 1), (-3, [float("nan")] + x[0][1:], 1), (-4, x[0][:7] + [float("-inf")], 1), (5000, x[0][:4], 1)]
    got, digest, _ = codes_of(spark, bad + sound)
    assert (got, digest) == brute_codes(sound)
    assert codes_of(spark, bad[:4])[0] == Counter()
    with pytest.raises(Exception, match="beyond"):
        codes_of(spark, [(1, [1e9] * 4, 1)])


def test_grid_memo(monkeypatch):
    """A full memo starts anew, cells are used again, and the kept entries hold every nearest one."""
    rng = np.random.default_rng(5)
    grid = code_grid.Grid(rng.integers(-600, 600, (256, 4)))
    parts = rng.integers(-700, 700, (5000, 4))
    for _ in range(2):
        code, far = grid.nearest(parts)
        d = ((parts[:, None] - grid.entries[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (far == d.min(1)).all()
    assert len(grid.memo) < 5000 and np.mean([len(v) for v in grid.memo.values()]) < 64
    monkeypatch.setattr(code_grid, "MOST_CELLS", 100)
    code, _ = code_grid.Grid(grid.entries).nearest(parts)
    assert (code == d.argmin(1)).all()


def test_decode(spark):
    _, _, books = codes_of(spark, [(i, x, 0) for i, x in enumerate(vectors(50, 8, 1))])
    assert code_grid.decode("000102ff"[:6] + "03", books).tolist() == np.concatenate([books[0][0], books[1][1], books[2][2], books[3][3]]).tolist()


# 13


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by resharing the excess again and again: {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        rest, heavy = total - sum(2 * sizes[s] for s in stopped), sum(w[s] for s in order if s not in stopped)
        out = {s: 2.0 * sizes[s] if s in stopped else w[s] * (rest / heavy) for s in order}
        above = {s for s in order if s not in stopped and out[s] > 2 * sizes[s]}
        if not above:
            return out
        stopped |= above


def test_mix(spark, docs):
    rows = [(100 + i, " ".join(["w"] * (37 * i % 5000)), None, f"z{i % 4}" if i % 7 else "big") for i in range(300)]
    d = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = source_mix.taken_words(d).collect()
    size = Counter()
    for r in d.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    targets = plain_targets(size)
    assert len(got) == d.count() and sorted(r.size for r in got) == sorted(len(WORD.findall(r.text or "")) for r in d.collect())
    placed, sources = source_mix.laid_out(d)
    assert {r.source: (r.source_size, r.target) for r in sources.collect()} == {s: (size[s], pytest.approx(targets[s], abs=1e-6)) for s in size}
    pieces = source_mix.mix(placed, sources).collect()
    taken = Counter()
    for r in pieces:
        taken[r.source] += r.length or 0
        assert r.length is None or (r.length > 0 and r.start >= 0 and r.start + r.length <= r.size)
    assert all(0 <= targets[s] - taken[s] < 1 for s in size)
    assert all(r.taken <= 2 * r.size for r in got) and sum(r.taken for r in got) == sum(taken.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, source_mix.taken_words(d.repartition(7)).collect()), key=str)
    # Every lap's words are taken once: pieces of one lap of one document do not overlap.
    seen = Counter()
    for r in pieces:
        if r.length:
            seen.update((r.source, r.chunk, r.number, r.lap, x) for x in range(r.start, r.start + r.length))
    assert max(seen.values()) == 1


def test_schedule_is_even(spark):
    """Every stretch of slots holds each source in proportion, and slots take blocks in their order."""
    s = spark.createDataFrame([(0, 600_000, 500_000.0), (1, 200_000, 200_000.0), (2, 60_000, 100_000.0), (3, 0, 0.0)], "source_no long, source_size long, target double")
    rows = sorted((r.slot, r.source_no, r.lap, r.block, r.words) for r in source_mix.schedule(s, 100).collect())
    share, seen = {0: 5 / 8, 1: 2 / 8, 2: 1 / 8}, Counter()
    assert len({r[0] for r in rows}) == len(rows)
    last = {}
    for n, (_, source, lap, block, _) in enumerate(rows, 1):
        seen[source] += 1
        assert abs(seen[source] - n * share[source]) < 8
        assert last.get(source, (-1, 0)) < (lap, block)
        last[source] = (lap, block)
    words = Counter()
    for r in rows:
        words[r[1]] += r[4]
    assert words == {0: 500_000, 1: 200_000, 2: 100_000}


def test_schedule_in_chunks(spark, monkeypatch):
    """Sources that are cut over tasks have the same slots."""
    s = spark.createDataFrame([(0, 5000, 9000.0), (1, 700, 650.5), (2, 3, 6.0)], "source_no long, source_size long, target double")
    whole = sorted(map(tuple, source_mix.schedule(s, 10).collect()))
    monkeypatch.setattr(source_mix, "CHUNK", 16)
    assert sorted(map(tuple, source_mix.schedule(s, 10).collect())) == whole and len(whole) == 900 + 65 + 2


def test_mix_empty(spark, docs):
    assert source_mix.taken_words(docs.limit(0)).count() == 0
    bare = source_mix.taken_words(documents(spark, [(1, None, None, None), (2, " ", None, "a"), (2, " ", None, "a")])).collect()
    assert sorted(map(tuple, bare)) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


def test_reversed_bits(spark):
    rows = spark.range(64).select("id", source_mix.reversed_bits(F.col("id"), 6).alias("r")).collect()
    assert [r.r for r in rows] == [int(f"{r.id:06b}"[::-1], 2) for r in rows]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_code_grid", "op13_source_mix"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in SQL_TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.001/{t}.parquet'")
    flat = lambda df: sorted(tuple(round(float(x), 6) if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert flat(queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()) == flat(con.sql(queries.ORACLE_SQL[name]).df())
