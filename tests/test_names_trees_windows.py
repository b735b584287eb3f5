"""Names by suffixes, trees of any depth, and windows over any number of blocks, against plain readings."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusq.operators import glossary, multiterm, scope, snippets, story, suffixes, suggest
from corpusq.sources import publish, storage


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


NAMES = ["第112话", "saber王", "12号机", "间桐远坂", "远坂凛", "the foo bar", "foo barn", "Foo Bar", "food", "xfoo bar", "é12", "o'foo", "ＡＢ", "a", "", None, "a", "12", "x.y z", "😀凛"]
ASKED = ["12话", "aber王", "2号", "远坂", "凛", "foo b", "foo bar", "FOO", "12", "a", "é", "'", "oo", "zz", "", None, "x.y", "the foo bar baz", "\U0010ffff", "😀"]


def latin(q):
    return bool(re.search("[A-Za-z]", q)) and not re.search("[぀-ヿ㐀-鿿]", q)


def place(q, name):
    """Where a name holds a query first, or None."""
    pattern = re.escape(q.lower())
    m = re.search(rf"(?<![a-z0-9]){pattern}" if latin(q) else pattern, name.lower())
    return m.start() if q and m else None


@pytest.mark.parametrize("size", [1 << 17, 5])
def test_names_with(spark, monkeypatch, size):
    """All names of all queries, in one range and in many."""
    monkeypatch.setattr(suffixes, "RANGE", size)
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, q string")
    expected = sorted({(i, n, place(q, n)) for i, q in enumerate(ASKED) for n in NAMES if q and n and place(q, n) is not None})
    assert rows(suffixes.names_with(asked, names), "query_id", "name", "at") == expected
    assert {("12话", "第112话"), ("aber王", "saber王"), ("2号", "12号机"), ("远坂", "间桐远坂"), ("foo b", "the foo bar")} <= {(ASKED[i], n) for i, n, _ in expected}
    assert suffixes.names_with(asked, names.limit(0)).count() == 0 and suffixes.names_with(asked.limit(0), names).count() == 0


def test_random_names(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE", 300)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab凛 1") for _ in range(n))
    names, asked = [word(rng.randint(1, 9)) for _ in range(400)], [word(rng.randint(1, 3)) for _ in range(120)]
    expected = sorted({(i, n, place(q, n)) for i, q in enumerate(asked) for n in names if place(q, n) is not None})
    found = suffixes.names_with(spark.createDataFrame(list(enumerate(asked)), "query_id long, q string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert rows(found, "query_id", "name", "at") == expected and len(expected) > 3000


def test_completion_tiers(spark):
    """Start, whole word, longer word for Latin prefixes; start and inside for others; then frequency, length, name."""
    vocab = spark.createDataFrame([(n, i % 3) for i, n in enumerate(NAMES) if n], "t string, n long")
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, q string")
    best = {}
    for i, n in enumerate(NAMES):
        if n:
            best[n] = max(best.get(n, 0), i % 3)
    expected = []
    for i, q in enumerate(ASKED):
        hits = [(n, place(q, n)) for n in best if q and place(q, n) is not None]
        tier = lambda n, at: 0 if at == 0 else 2 if latin(q) and re.match("[a-z0-9]", n.lower()[at + len(q) :]) else 1  # noqa: B023, E731
        order = sorted((tier(n, at), -best[n], len(n), n.encode()) for n, at in hits)
        expected += [(i, t.decode(), k, p + 1) for p, (k, _, _, t) in enumerate(order[:10])]
    assert rows(suggest.suggest_raw(asked, vocab), "query_id", "t", "tier", "place") == sorted(expected)
    many = spark.createDataFrame([(f"name{i} x", 1) for i in range(40)], "t string, n long")
    assert suggest.suggest_raw(asked.limit(1).withColumn("q", F.lit("name")), many, None).count() == 40


def test_inside_matches_of_entries(spark):
    """Cards are found by what stands inside their names."""
    e = spark.createDataFrame([(i, n, "body") for i, n in enumerate(NAMES) if n], "entry_id long, term string, body string")
    q = spark.createDataFrame([(1, "12话"), (2, "aber王"), (3, "2号"), (4, "远坂"), (5, "Foo bar")], "query_id long, q string")
    got = {(r.query_id, NAMES[r.entry_id], r.match) for r in glossary.match_entries(q, e).collect()}
    assert got == {(1, "第112话", "contains"), (2, "saber王", "contains"), (3, "12号机", "contains"), (4, "间桐远坂", "contains"), (4, "远坂凛", "contains"), (5, "the foo bar", "contains"), (5, "foo barn", "contains"), (5, "Foo Bar", "exact")}


def test_trees_of_any_depth(spark):
    """A chain of 2000 nodes, random forests, parents that are not there; a cycle is an error."""
    chain = [(i, i - 1 if i else None, 1) for i in range(2000)]
    assert rows(scope.count_tree(spark.createDataFrame(chain, "node long, parent long, n long")), "node", "n") == [(i, 2000 - i) for i in range(2000)]
    rng = random.Random(2)
    forest = [(i, rng.choice([None, 999, *range(max(0, i - 4), i)]), rng.randint(0, 5)) for i in range(120)]
    total = {i: n for i, _, n in forest}
    for i, up, _ in reversed(forest):
        if up is not None and up != 999:
            total[up] += total[i]
    assert rows(scope.count_tree(spark.createDataFrame(forest, "node long, parent long, n long")), "node", "n") == sorted(total.items())
    with pytest.raises(ValueError, match="cycle"):
        scope.count_tree(spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, None, 1)], "node long, parent long, n long"))


def test_windows_over_many_blocks(spark):
    """Snippets equal windows over all blocks of the document, however many are needed."""
    rng = random.Random(8)
    docs = {0: ["12345"] * 60, 1: ["a"] * 400, 2: ["x" * 170, "b", "y" * 900, "c", "z" * 100], 3: ["one"]}
    for d in range(4, 30):
        docs[d] = ["".join(rng.choice("字文。 ") or "字" for _ in range(rng.choice((1, 2, 5, 40, 179, 300, 900)))).strip() or "空" for _ in range(rng.randint(1, 40))]
    # Places with gaps: blocks with more than eight empty places between them are not neighbours.
    places = {d: [sum(rng.choice((1, 1, 1, 3, 12)) for _ in range(i + 1)) for i in range(1)] for d in docs}
    for d, texts in docs.items():
        at, out = 0, []
        for _ in texts:
            out.append(at)
            at += rng.choice((1, 1, 1, 3, 12)) if d > 3 else 1
        places[d] = out
    b = spark.createDataFrame([(d, o, t) for d, texts in docs.items() for o, t in zip(places[d], texts)], "doc long, ord int, text string")
    hits = b.select("doc", "ord", F.lit(0).alias("start"), F.lit(1).alias("end"))
    got = {(r.doc, r.ord): r.snippet for r in snippets.with_snippets(hits, b).collect()}
    assert len(got) == sum(map(len, docs.values()))
    for d, texts in docs.items():
        for i, o in enumerate(places[d]):
            text, before, after = snippets.paragraph_window(texts, i, 0, 1, places[d])
            tidy = re.sub(" +", " ", text.replace("\n", " ")).strip(" ")
            assert got[d, o] == ("…" if before else "") + tidy + ("…" if after else ""), (d, o)
    middle = got[0, 30]
    assert middle.startswith("…") and middle.endswith("…") and len(middle) >= 180


def test_canonical_documents_of_moved_numbers(spark):
    """File 400 stands for chapter 401, after a file of the chapter's own number; titles go with their part."""
    chapters = spark.createDataFrame([(1, 401, "a", ""), (2, 7, "b", ""), (3, None, "same", "one"), (4, None, "same", "two")], "chapter long, number int, title string, part string")
    docs = spark.createDataFrame([(10, "d/400_x", "q", ""), (11, "d/401_x", "q", ""), (12, "d/7_y", "same", "one"), (13, "d/y", "same", "one"), (14, "d/z", "same", ""), (15, "e/z", "same", "one")], "doc long, file string, title string, part string")
    kept, gone = story.canonical_documents(chapters, docs)
    assert rows(kept, "chapter", "doc") == [(1, 11), (2, 12), (3, 13), (4, 14)]
    assert rows(gone, "doc", "canonical") == [(10, 11), (15, 13)]
    assert rows(story.canonical_documents(chapters, docs.where("doc = 10"))[0], "chapter", "doc") == [(1, 10)]


def test_scope_bitmaps(spark):
    """Bits of ids near the edges of buckets; no scope, all, unknown keys, unknown queries, documents in no scope."""
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 10**12, 10**12 + 7]
    table = spark.createDataFrame([(key, d) for n, key in enumerate(("a", "b", "c")) for d in ids if d % 3 == n], "scope_key string, doc long")
    asked = [(1, "a"), (2, "b"), (3, ""), (4, "all"), (5, None), (6, "none"), (7, "c")]
    hits = [(q, d, f"x{d}") for q in range(1, 9) for d in [*ids, 5, 40000]]
    got = scope.within(spark.createDataFrame(hits, "query_id long, doc long, text string"), spark.createDataFrame(asked, "query_id long, scope string"), scope.scope_bitmaps(table))
    keys = dict(asked)
    held = lambda q, d: q in keys and (keys[q] in (None, "", "all") or (d in ids and {"a": 0, "b": 1, "c": 2}.get(keys[q]) == d % 3))
    assert got.columns == ["query_id", "doc", "text"] and rows(got, "query_id", "doc", "text") == sorted(h for h in hits if held(*h[:2]))


def test_versions_survive_crashes(spark, tmp_path, monkeypatch):
    """A run that dies between tables and manifest, one that fails a check, and a torn table."""
    folder, table = f"file://{tmp_path}", spark.range(100).withColumn("t", F.concat(F.lit("x"), "id"))
    with pytest.raises(FileNotFoundError):
        publish.current_version(spark, folder)
    assert publish.publish_version(spark, {"a": table, "b": table.limit(3)}, folder, {}) == 1
    held = publish.read_version(spark, folder)

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(publish, "_described", dies)
    monkeypatch.setattr(publish, "deleted", lambda *_: None)  # nothing is cleared by a process that is gone
    with pytest.raises(KeyboardInterrupt):
        publish.publish_version(spark, {"a": table.limit(1)}, folder, {})
    monkeypatch.undo()
    assert "v=2" in storage.listed(spark, folder) and publish.current_version(spark, folder) == 1 and held["a"].count() == 100
    with pytest.raises(ValueError, match="check none failed for version 2"):
        publish.publish_version(spark, {"a": table}, folder, {"none": lambda t: t["a"]})
    assert sorted(storage.listed(spark, folder)) == ["manifests", "v=1"] and publish.versions(spark, folder) == [1]
    assert publish.publish_version(spark, {"a": table.limit(7)}, folder, {}) == 2
    assert publish.read_version(spark, folder)["a"].count() == 7 and publish.read_version(spark, folder, 1)["a"].count() == 100 and held["a"].count() == 100
    part = next(p for p in (tmp_path / "v=1" / "a").iterdir() if p.suffix == ".parquet" and p.stat().st_size > 600)
    part.unlink()
    with pytest.raises(ValueError, match="table a of version 1 is torn"):
        publish.read_version(spark, folder, 1)
    (tmp_path / "manifests" / "v=2" / "_SUCCESS").unlink()  # a manifest that was never committed
    assert publish.current_version(spark, folder) == 1


def test_fragments_take_neighbours(spark):
    """A fragment of a short block reads on over its neighbours; one of a long block is its own window."""
    texts = ["alpha. "] + ["filler words here"] * 20 + ["Alpha and beta"] + ["more filler words"] * 20
    long = ["first", "alpha beta " + "word. " * 200, "last"]
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, i, t) for i, t in enumerate(long)], "doc long, ord int, text string")
    g = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "beta")], "query_id long, `group` int, term string")
    found = multiterm.fragments(multiterm.match_units(g, b), b)
    got = {r.doc: r for r in multiterm.fragment_snippets(found, b).collect()}
    assert sorted(got) == [1, 2] and {r.mask for r in got.values()} == {3} and got[1].text == "Alpha and beta"
    assert got[1].snippet.startswith("…") and got[1].snippet.endswith("…") and len(got[1].snippet) > 180 and "words here Alpha and beta more" in got[1].snippet
    assert got[2].snippet.startswith("…alpha beta word.") and got[2].snippet.endswith("…") and len(got[2].snippet) <= 800


def test_paragraphs_of_limit_size():
    """A paragraph stands whole up to 798 characters, so that with ellipses it has 800."""
    for n, whole in ((797, True), (798, True), (799, False), (800, False)):
        text = "字。" * (n // 2) + "字" * (n % 2)
        assert (snippets.block_window(text, 3, 4) == (0, n)) == whole and (snippets.paragraph_window([text], 0, 3, 4)[0] == text) == whole
