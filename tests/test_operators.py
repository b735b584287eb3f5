"""Operators on inline fixtures; the sample queries cover the rest against SQL."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.operators import aliases, blocks, build, glossary, multiterm, occurrences, qa, quality, reading, search, snippets, story
from corpusq.sources import ingest, publish


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_language_runs_and_pairs(spark):
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(["これは日本語", "这是中文", "……", "また日本語です", "ひとつだけ"])], "doc long, ord int, text string")
    tagged = blocks.tagged_lines(b)
    assert [r.lang for r in tagged.orderBy("ord").collect()] == ["ja", "zh", "zh", "ja", "ja"]
    runs = blocks.language_runs(tagged)
    assert rows(blocks.drop_paired_runs(runs), "lang", "first_ord") == [("ja", 3), ("zh", 1)]
    assert rows(blocks.split_visible(tagged), "visible") == [("这是中文\n……",)]


def test_shadowing_and_levels(spark):
    b = spark.createDataFrame([(1, 0, "Arc Drive and Arc"), (2, 0, "only Drive")], "doc long, ord int, text string")
    g = spark.createDataFrame([(1, 0, "Arc"), (1, 1, "Arc Drive"), (1, 2, "none")], "query_id long, `group` int, term string")
    units = multiterm.match_units(g, b)
    assert rows(units, "doc", "mask") == [(1, 3)]  # a longer term of one group hides no term of another
    assert rows(multiterm.effective_level(units), "level") == [(2,)]
    assert rows(multiterm.fragments(units, b), "doc", "mask") == [(1, 3)]


def test_scan_and_index_agree(spark):
    b = spark.createDataFrame([(1, 0, "远坂凛来了"), (1, 1, "rin and Rin."), (2, 0, "凛"), (3, 0, "")], "doc long, ord int, text string")
    t = spark.createDataFrame([(1, "远坂凛"), (2, "rin"), (3, "凛"), (4, "absent")], "query_id long, term string")
    a, c = occurrences.scan_occurrences(t, b), occurrences.index_occurrences(t, b)
    assert rows(a, "query_id", "doc", "ord", "n") == rows(c, "query_id", "doc", "ord", "n") == [(1, 1, 0, 1), (2, 1, 1, 2), (3, 1, 0, 1), (3, 2, 0, 1)]


def test_scan_and_index_agree_on_tolerant_terms(spark):
    """Dots and spaces of a term may be missing or others; both ways find the same rows, for few terms and for many."""
    texts = ["theand one", "the and, The·and", "other lathe and", "远坂来了", "远·坂和远 坂", "单远", "foo-bar.baz", "foobarbaz", "foo bar", "1 2 3 and 123", "x1234", "Café au lait", "月姬R 与 月姬 R", "a.b", "ab", "É.B", "", " . "]
    b = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "doc long, ord int, text string")
    asked = ["The and", "远坂", "远 坂", "远·坂", "foo bar", "foo-bar baz", "12", "123", "1 2", "café", "月姬R", "月姬 R", "a.b", "é", "é b", "au lait", "远", "r", "·", "none at all"]
    terms = [(i, t) for i, t in enumerate(asked)]
    many = terms + [(1000 + i, f"filler{i}") for i in range(250)]
    t, m = (spark.createDataFrame(x, "query_id long, term string") for x in (terms, many))
    columns = ["query_id", "doc", "ord", "n", "positions"]
    scan, index = (rows(f(t, b), *columns) for f in (occurrences.scan_occurrences, occurrences.index_occurrences))
    assert scan == index == rows(occurrences.occurrences(m, b), *columns)
    held = {(asked[q], texts[d]) for q, d, *_ in scan}
    assert {("The and", "theand one"), ("远 坂", "远坂来了"), ("远·坂", "远坂来了"), ("远·坂", "远·坂和远 坂"), ("12", "x1234"), ("月姬 R", "月姬R 与 月姬 R"), ("a.b", "ab")} <= held
    assert ("The and", "other lathe and") not in held and ("远坂", "远·坂和远 坂") not in held
    with pytest.raises(ValueError, match="over 200 terms"):
        occurrences.scan_occurrences(m, b)


def test_fragments_of_several_queries(spark):
    """A query's fragments do not depend on the others; without a window that holds the level the middle stands in."""
    far = "begin " + "x" * 3000 + " end"
    b = spark.createDataFrame([(1, 0, "Arc and Drive"), (2, 0, far)], "doc long, ord int, text string")
    g = [(1, 0, "Arc"), (1, 1, "Drive"), (2, 0, "Arc"), (2, 1, "and"), (3, 0, "begin"), (3, 1, "end")]
    of = lambda x: rows(multiterm.fragments(multiterm.match_units(spark.createDataFrame(x, "query_id long, `group` int, term string"), b), b), "query_id", "doc", "start", "end", "mask", "text")
    whole = of(g)
    assert whole == sorted(r for q in (1, 2, 3) for r in of([x for x in g if x[0] == q]))
    assert [r[:5] for r in whole] == [(1, 1, 0, 13, 3), (2, 1, 0, 13, 3), (3, 2, 1303, 1703, 3)]


def test_numbered(spark):
    from corpusq.operators.ordering import numbered

    d = spark.createDataFrame([(k, m, doc, o) for k in "ab" for m in (None, 1) for doc in (9000, 3, 4097) for o in (1, 0)], "k string, m int, doc long, ord int")
    got = rows(numbered(d, ["k"], ["m"], ["doc", "ord"], "n"), "k", "n", "m", "doc", "ord")
    assert got == [(k, n + 1, *x) for k in "ab" for n, x in enumerate((m, doc, o) for m in (None, 1) for doc in (3, 4097, 9000) for o in (0, 1))]


def test_batch_equals_loop(spark):
    b = spark.createDataFrame([(i, 0, f"the word{i} of") for i in range(20)], "doc long, ord int, text string")
    t = [(1, "the"), (2, "word7"), (3, "of")]
    together = rows(occurrences.occurrences(spark.createDataFrame(t, "query_id long, term string"), b), "query_id", "doc")
    alone = sorted(r for x in t for r in rows(occurrences.occurrences(spark.createDataFrame([x], "query_id long, term string"), b), "query_id", "doc"))
    assert together == alone


def test_aliases(spark):
    raw = spark.createDataFrame([(1, '{"nick": "term", "self": "self"}'), (2, '{"nick": "late", "many": ["a", "b"]}')], "source int, json string")
    assert rows(aliases.load_aliases(raw), "nick", "targets") == [("many", ["a", "b"]), ("nick", ["term"])]
    table = spark.createDataFrame([("att", ["attion"], 1)], "nick string, targets array<string>, priority int")
    q = spark.createDataFrame([(1, "att, of"), (2, "one"), (3, "att, attion")], "query_id long, q string")
    assert rows(aliases.term_groups(q, table), "query_id", "group", "canonical") == [(1, 0, "attion"), (1, 1, "of")]


@pytest.mark.parametrize(("text", "at", "longest"), [("短句。" * 3, 0, 360), ("很长的句子，" * 200 + "。", 300, 600), ("一。" * 400, 401, 360), ("", 0, 0)])
def test_sentence_window(text, at, longest):
    a, b = snippets.sentence_window(text, at, at + 1)
    assert 0 <= a <= b <= len(text) and b - a <= longest and (not text or a <= at < b)


def test_cut_long_against_all_pairs():
    """The widest stretch of all pairs of clause marks, on random lines."""
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("字字字字字字，；。\n" if rng.random() < 0.5 else "字") for _ in range(rng.randint(1, 400)))
        start = rng.randrange(len(text))
        end, hard = min(len(text), start + rng.randint(1, 5)), rng.choice((20, 60, 200))
        if "\n" in text[start:end]:
            continue
        a, b = snippets._cut_long(text, start, end, hard)
        low, high = text.rfind("\n", 0, start) + 1, (text + "\n").index("\n", start)
        cuts = [low, *(i + 1 for i in range(low, high) if text[i] in "，；。"), high]
        pairs = [(z - x, -x) for x in cuts for z in cuts if x <= start and (z > end or z == high) and z - x <= hard]
        assert a <= start and end <= b and b - a <= max(hard, end - start)
        assert high - low <= hard or not pairs or (b - a, -a) == max(pairs)


def test_paragraph_window():
    assert snippets.paragraph_window(["前", "中" * 200, "后"], 1, 3, 4) == ("中" * 200, True, True)
    assert snippets.paragraph_window(["前", "中", "后"], 1, 0, 1) == ("前\n中\n后", False, False)
    assert snippets.paragraph_window(["前", "中", "后"], 1, 0, 1, [0, 9, 19]) == ("前\n中", False, True)
    text, before, _ = snippets.paragraph_window(["句。" * 900], 0, 1000, 1001)
    assert len(text) <= 798 and before


def test_near_duplicates(spark):
    same, other = "字" * 50, [chr(0x4E00 + i) for i in range(60)]
    cards = [(1, "g", same + "".join(other[:20])), (2, "g", same + "".join(other[20:40])), (3, "h", "字" * 45 + "".join(other[:20])), (4, "h", "字" * 45 + "".join(other[20:40]))]
    d = spark.createDataFrame(cards, "card_id long, group_id string, body string")
    assert rows(glossary.matching_pairs(d), "a", "b") == [(1, 2)]  # 0.714 merges, 0.692 does not
    assert rows(glossary.clusters(d, glossary.matching_pairs(d)), "card_id", "cluster") == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_extract_qa(spark):
    text = ["Q：第一个问题？", "A：第一个回答。", "继续回答。", "Q：第二个问题？ A：第二个回答。"]
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc long, ord int, text string")
    assert rows(qa.extract_qa(b), "start", "end", "q", "a") == [(0, 3, "第一个问题？", "第一个回答。\n继续回答。"), (3, 4, "第二个问题？", "第二个回答。")]
    legacy = spark.createDataFrame([(1, "第一个问题？", "旧的回答内容")], "doc long, q string, a string")
    assert rows(qa.build_qa_index(b, legacy), "q", "origin") == [("第一个问题？", "extracted"), ("第二个问题？", "extracted")]


def plain_qa(blocks):
    """(start, end, q, a) by reading one document's blocks from front to back."""
    question, answer, speaker = (re.compile(p.replace("(?m)", "", 1), re.M) for p in (qa.QUESTION, qa.ANSWER, qa.SPEAKER))
    names = {}
    for _, t in blocks:
        for m in speaker.finditer(t):
            if m[1].strip() and not re.match(qa.MARK_NAME, m[1].strip()):
                names[m[1].strip()] = names.get(m[1].strip(), 0) + 1
    asked = [(i, m) for i, (_, t) in enumerate(blocks) for m in question.finditer(t)]
    bare = lambda t: re.sub(tx.QA_PUNCTUATION, "", t)
    out = []
    for k, (i, m) in enumerate(asked):
        text, after = blocks[i][1], asked[k + 1] if k + 1 < len(asked) else None
        own, name = answer.search(text, m.end()), speaker.search(text, m.end())
        if name:
            who = name[1].strip()
            if not who or who.lower().startswith("http") or not (who[0] in "AＡ答" or re.search("[?？]", text[m.end() : name.start()]) or names.get(who, 0) >= 2):
                continue
        stop = own or name
        inside = after if after and after[0] == i else None
        if inside and inside[1].start() < (stop.start() if stop else len(text)):
            stop = None
        if stop:
            q, a, last = text[m.end() : stop.start()].strip(), text[own.end() if own else name.start() : inside[1].start() if inside else len(text)].strip(), i
        elif inside:
            continue
        else:
            q, parts, last = text[m.end() :].strip(), [], None
            for j in range(i + 1, len(blocks)):
                end = after[1].start() if after and j == after[0] else len(blocks[j][1])
                if end or j == i + 1:
                    last = j
                parts.append(blocks[j][1][:end].strip())
                if after and j == after[0]:
                    break
            a = "\n".join(x for x in parts if x)
        a = re.sub(r"^(?:[AＡaａ]\s*[：:]|(?:答|回答)\s*[：:])[ \t]*", "", a).strip()
        a = re.sub(r"(?:\s*\n?[ \t]*[-—－━=]{4,}[ \t]*)+$", "", a)
        if len(bare(q)) >= 2 and len(bare(a)) >= 2:
            out.append((blocks[i][0], blocks[last][0] + 1, q, a))
    return out


def test_extract_qa_against_reading(spark):
    """Documents put together at random from questions, answers, speakers and plain lines."""
    parts = ["Q：这是问题吗？", "问：说说看", "A：这是回答。", "答：好的好的", "奈须：我来回答这个。", "武内：是这样的？", "路人：只说一次", "普通的一行文字", "http：//x.y 链接", "……", "Q：第二个？ A：同一行回答", "Q：连着问 Q：再问一次？ 奈须：回答在此", "----", "奈须：又一次发言"]
    rng = random.Random(5)
    docs = {d: [(i * 2, "\n".join(rng.choice(parts) for _ in range(rng.choice((1, 1, 2, 3))))) for i in range(rng.randint(1, 8))] for d in range(150)}
    b = spark.createDataFrame([(d, i, t) for d, bs in docs.items() for i, t in bs], "doc long, ord int, text string")
    got = {}
    for r in qa.extract_qa(b).collect():
        got.setdefault(r.doc, []).append((r.start, r.end, r.q, r.a))
    expected = {d: sorted(plain_qa(bs)) for d, bs in docs.items() if plain_qa(bs)}
    assert {d: sorted(x) for d, x in got.items()} == expected and sum(map(len, expected.values())) > 100


def test_fragments_against_loop(spark):
    """Windows of random blocks equal those of a loop over anchors."""
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "other", "thing", "more。", "end. "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((20, 60, 400)))) for _ in range(25)]
    b = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, ord int, text string")
    groups = [(1, 0, "alpha"), (1, 1, "beta"), (2, 0, "gamma"), (2, 1, "alpha"), (2, 2, "beta")]
    expected = []
    for query in (1, 2):
        own = [(g, t) for q, g, t in groups if q == query]
        held = [[(g, [m.start() for m in re.finditer(rf"(?<![A-Za-z0-9]){w}(?![A-Za-z0-9])", t)]) for g, w in own] for t in texts]
        held = [[(g, p) for g, p in h if p] for h in held]
        level = max(map(len, held))
        for doc, (t, h) in enumerate(zip(texts, held)):
            if len(h) < level:
                continue
            anchors = [p[i] for i in range(20) for _, p in h if i < len(p)][:40]
            seen, out = set(), []
            for at in anchors:
                a, z = snippets.block_window(t, at, at + 1)
                inside = [g for g, ps in h if any(a <= p < z for p in ps)]
                flat = re.sub(r"\s+", "", t[a:z])
                if len(inside) >= level and flat not in seen:
                    seen.add(flat)
                    out.append((query, doc, a, z, sum(1 << g for g in inside)))
            if not out:
                mid = (min(p[0] for _, p in h) + max(p[0] for _, p in h)) // 2
                out = [(query, doc, max(0, mid - 200), min(len(t), mid + 200), sum(1 << g for g, _ in h))]
            expected += out
    units = multiterm.match_units(spark.createDataFrame(groups, "query_id long, `group` int, term string"), b)
    assert rows(multiterm.fragments(units, b), "query_id", "doc", "start", "end", "mask") == sorted(expected) and len(expected) > 30


def test_bundle(spark, tmp_path):
    empty = {"docs": [{"id": 1, "title": "t", "work": "", "meta": {"a": "b"}}], "entries": [{"term": "x", "doc": 1, "source_refs": [{"doc": 1, "start": 0, "end": 2}]}], "qa": [], "interviews": [{"term": "i", "doc": 1}]}
    for name, data in empty.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    got = ingest.load_bundle(spark, str(tmp_path))
    assert rows(got["docs"], "id", "title", "work") == [(1, "t", None)] and got["qa"].count() == 0
    assert got["entries"].first().source_refs[0].end == 2 and got["interviews"].first().term == "i"


def test_assemble_volume(spark):
    rows_ = [(1, 1, 0, "paragraph", "第一章"), (1, 1, 1, "paragraph", "第二章"), (1, 1, 2, "paragraph", "字" * 60), (1, 1, 3, "heading", "第一章（上）"), (1, 1, 4, "paragraph", "甲"), (1, 2, 0, "paragraph", "乙"), (1, 2, 1, "heading", "第二章"), (1, 2, 2, "paragraph", "丙"), (1, 2, 3, "heading", "插画"), (1, 2, 4, "paragraph", "丁")]
    b = spark.createDataFrame(rows_, "volume long, doc long, ord int, kind string, text string")
    chapters, audit = build.assemble_volume(b, spark.createDataFrame([(1, 1, 67), (1, 2, 9)], "volume long, doc long, chars int"))
    assert rows(chapters, "title", "text") == [("第一章", "甲\n乙"), ("第二章", "丙")]
    assert rows(audit, "doc", "parsed", "ok") == [(1, 67, True), (2, 3, False)]


def test_build_index_tables(spark):
    c = spark.createDataFrame([(1, 0, "new", 0, "正文一<br>これは日本語です"), (1, 1, "old", 0, "旧正文"), (2, 1, "old", 0, "旧正文"), (3, 1, "old", 0, "旧正文"), (4, 0, "new", 0, "http://x.y"), (4, 1, "old", 1, "后备"), (5, 1, "old", 0, "去掉")], "doc long, priority int, source string, ord int, text string")
    docs = spark.createDataFrame([(i, "W", f"t{i}") for i in range(1, 6)], "doc long, work string, title string")
    gone = spark.createDataFrame([(5, "merged")], "doc long, reason string")
    chapters = spark.createDataFrame([(3, 0, None, "story › one")], "doc long, start int, end int, path string")
    got = build.build_index(c, docs, gone, chapters)
    assert rows(got["blocks"], "doc", "text") == [(1, "正文一"), (3, "旧正文"), (4, "后备")]
    assert rows(got["foreign"], "doc", "text") == [(1, "これは日本語です")] and rows(got["excluded"], "doc", "canonical") == [(2, 3), (5, None)]
    assert rows(got["locations"], "doc", "path") == [(1, "W › t1"), (3, "story › one"), (4, "W › t4")]


def test_ambiguous_definitions_and_fallback(spark):
    e = [(1, "g1", "saber", "body of saber"), (2, "g2", "archer", "archer, an ally of saber"), (3, "g3", "sabers", "plural")]
    entries = spark.createDataFrame([(*x, 0, 0) for x in e], "entry_id long, group_id string, term string, body string, family int, freq int")
    table = spark.createDataFrame([("servant", ["archer", "saber"], 1)], "nick string, targets array<string>, priority int")
    q = spark.createDataFrame([(1, "servant"), (2, "sab"), (3, "the archer herself")], "query_id long, q string")
    parts = spark.createDataFrame([(3, "herself", 1), (3, "archer", 2)], "query_id long, part string, place int")
    got = rows(search.definitions(q, table, entries, parts), "query_id", "place", "entry_id", "match")
    assert got == [(1, 1, 2, "exact"), (1, 2, 1, "exact"), (2, 1, 1, "contains"), (2, 2, 3, "contains"), (3, 1, 2, "exact")]
    both = spark.createDataFrame([(1, "ab"), (1, "abc")], "query_id long, term string")
    blk = spark.createDataFrame([(1, 0, "远ab abc")], "doc long, ord int, text string")
    cjk = spark.createDataFrame([(2, "远坂"), (2, "远坂凛")], "query_id long, term string")
    assert rows(search.variant_hits(both, blk), "n") == [(2,)] and rows(search.variant_hits(cjk, spark.createDataFrame([(1, 0, "远坂凛，远坂")], "doc long, ord int, text string")), "n") == [(2,)]


def test_one_character_queries_see_bodies(spark):
    e = spark.createDataFrame([(1, "甲", "这里有凛的说明"), (2, "凛", "别的")], "entry_id long, term string, body string")
    assert rows(glossary.match_entries(spark.createDataFrame([(1, "凛")], "query_id long, q string"), e), "entry_id", "match") == [(1, "body"), (2, "exact")]


def test_labels_and_ranges(spark):
    s = spark.createDataFrame([("",), ("top:t",), ("work:w",), ("sub:w|a|b",), ("work:x",)], "scope string")
    got = dict(rows(reading.scope_labels(s, spark.createDataFrame([("t", "Top")], "top string, name string"), spark.createDataFrame([("w", "Work")], "work string, label string")), "scope", "label"))
    assert got == {"": "全部作品", "top:t": "Top（全部）", "work:w": "Work", "sub:w|a|b": "Work · a|b", "work:x": "x"}
    c = spark.createDataFrame([("k", 1, 2, 2)], "key string, doc long, start int, end int")
    b = spark.createDataFrame([(1, 2, "zh", "a"), (1, 2, "ja", "b"), (1, 3, "zh", "c")], "doc long, ord int, lang string, text string")
    assert rows(reading.chapter_blocks(c, b, "zh"), "ord", "lang") == [(2, "zh")]
    bad = quality.wrong_chapter_count(spark.createDataFrame([("w", "r")], "work string, route string"), spark.createDataFrame([("w", "r", 2), ("w", "s", 0)], "work string, route string, expected int"))
    assert rows(bad, "route", "n") == [("r", 1), ("s", None)]


def test_story_operators(spark):
    chapters = spark.createDataFrame([(1, 300, "开端"), (2, 500, "终章")], "chapter long, number int, title string")
    docs = spark.createDataFrame([(10, "x/300_a", "别的"), (11, "y/z", "开端"), (12, "y/w", "终章")], "doc long, file string, title string")
    kept, gone = story.canonical_documents(chapters, docs)
    assert rows(kept, "chapter", "doc") == [(1, 10), (2, 12)] and rows(gone, "doc", "canonical") == [(11, 10)]
    h = spark.createDataFrame([(1, 0, "序"), (1, 1, "一"), (1, 2, "序")], "doc long, ord int, title string")
    b = spark.createDataFrame([(1, 0, "序"), (1, 3, " 一 "), (1, 5, "序")], "doc long, ord int, text string")
    assert rows(story.heading_blocks(h, b), "heading", "block") == [(0, 0), (1, 3), (2, 5)]
    flat = "字" * 40
    src = spark.createDataFrame([("w", flat, "p"), ("w", "新" * 41, "q")], "work string, text string, path string")
    probe = spark.createDataFrame([("w", 1, 0, flat), ("w", 1, 1, "新" * 60)], "work string, doc long, ord int, text string")
    assert rows(story.path_by_shingle(probe, src), "ord", "path") == [(1, "q")]  # 40 characters have no piece


def test_official_lines(spark):
    parts = spark.createDataFrame([("p", [("c", [("s", [("A", "x"), ("B", "y")])])])], "part string, chapters array<struct<title:string,sections:array<struct<title:string,lines:array<struct<s:string,t:string>>>>>>")
    assert rows(story.flatten_official(parts), "title", "lines", "ord", "text") == [("c", 2, 0, "x"), ("c", 2, 1, "y")]


def test_sources(spark, tmp_path):
    for name, data in (("a.txt", "﻿你好\r\n".encode()), ("b.txt", "你好".encode("utf-16")), ("c.txt", "你好".encode("gb18030"))):
        (tmp_path / name).write_bytes(data)
    found = ingest.ingest_text(spark, str(tmp_path))
    assert sorted((r.text.strip(), r.encoding) for r in found.collect()) == [("你好", "gb18030"), ("你好", "utf-16"), ("你好", "utf-8-sig")]
    (tmp_path / "blocks.json").write_text('[[1, 0, "甲"], [1, 1, "乙"]]')
    assert rows(ingest.load_lang_blocks(spark, {"zh": str(tmp_path / "blocks.json")}), "doc", "ord", "text", "lang") == [(1, 0, "甲", "zh"), (1, 1, "乙", "zh")]
    (tmp_path / "events.tsv").write_text("kind\tname\nwar\tx\nother\ty\n", encoding="utf-16")
    assert ingest.load_event_rows(spark, str(tmp_path / "events.tsv"), {"kind": "war"}, 1).first().name == "x"
    with pytest.raises(ValueError, match="expected 2"):
        ingest.load_event_rows(spark, str(tmp_path / "events.tsv"), {"kind": "war"}, 2)


def test_publishing(spark, tmp_path):
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, " "), (2, 0, "bc")], "doc long, ord int, text string")
    publish.publish_blocks(t, str(tmp_path / "blocks"), 2)
    assert rows(spark.read.parquet(str(tmp_path / "blocks")), "doc", "ord", "start") == [(1, 0, 0), (2, 0, 2)]
    bad = {"none": lambda tables: tables["t"].where("doc = 2")}
    folder = str(tmp_path / "versions")
    assert publish.publish_version(spark, {"t": t.where("doc = 1")}, folder, bad) == 1
    with pytest.raises(ValueError, match="check none failed"):
        publish.publish_version(spark, {"t": t}, folder, bad)
    assert publish.current_version(spark, folder) == 1
    publish.publish_qa_index(t, str(tmp_path / "qa"))
    assert publish.qa_index_is_current(spark, str(tmp_path / "qa"), t) and not publish.qa_index_is_current(spark, str(tmp_path / "qa"), t.where("doc = 1"))


def test_plain_plans(spark):
    """Filters and columns reach the scan."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("source") == "src1")
    plan = blocks.blocks_from_documents(d)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in plan and "lang" not in plan.split("ReadSchema")[-1]


def test_clusters_of_a_long_chain(spark):
    """A chain of 1000 links, its ids in no order, is one cluster."""
    ids = [(i * 377) % 1001 for i in range(1001)]
    cards = spark.createDataFrame([(i,) for i in [*ids, 5000]], "card_id long")
    pairs = spark.createDataFrame([(min(x), max(x)) for x in zip(ids, ids[1:])], "a long, b long")
    got = {r.card_id: r.cluster for r in glossary.clusters(cards, pairs).collect()}
    assert got == {i: 0 for i in ids} | {5000: 5000}


def test_dealt_card_pairs(spark, monkeypatch):
    """Groups dealt over blocks give the pairs that all-pairs comparison gives."""
    monkeypatch.setattr(glossary, "DEALT", 4)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu "
    bodies = [base + f"tail{i % 5}" for i in range(9)] + [base * (1 + i) + f"more{i}" for i in range(6)] + ["short one", "", "quite another text that shares little with the rest of them here"]
    d = spark.createDataFrame([(i, "g", t) for i, t in enumerate(bodies)], "card_id long, group_id string, body string")
    skeleton = ["".join(c for c in t if c.isalnum()).lower() for t in bodies]
    grams = [{s[i : i + 3] for i in range(len(s) - 2)} for s in skeleton]
    close = [(a, b) for b in range(len(bodies)) for a in range(b) if grams[a] and min(len(skeleton[a]), len(skeleton[b])) >= 0.85 * max(len(skeleton[a]), len(skeleton[b])) and len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b])]
    assert rows(glossary.duplicate_pairs(d), "a", "b") == sorted(close) and close
    covered = [(a, b) for a in range(len(bodies)) for b in range(len(bodies)) if len(skeleton[a]) >= 40 and len(skeleton[b]) >= 1.35 * len(skeleton[a]) and len(grams[a] & grams[b]) >= 0.7 * len(grams[a])]
    assert rows(glossary.coverage(d), "short", "long") == sorted(covered) and covered


def test_equal_queries_are_resolved_once_without_targets(spark):
    """Many equal queries and a nick of many targets: equal to a plain reading; the search for the best alias carries no targets."""
    many = [f"t{i}" for i in range(40)]
    table = [("big", many, 1), ("Big", ["one"], 2), ("t7", ["seven"], 3), ("T8", ["x", "big"], 0)]
    asked = [(i, ["t7", "BIG", "big", "one", "none", "T8", None][i % 7]) for i in range(2800)]
    q, a = spark.createDataFrame(asked, "query_id long, q string"), spark.createDataFrame(table, "nick string, targets array<string>, priority int")

    def best(text):
        found = [((0 if w == text else 1) + way, p, nick, targets) for nick, targets, p in table for way, ws in ((2, [nick]), (0, targets)) for w in ws if text is not None and w.lower() == text.lower()]
        return min(found)[2:] if found else (None, None)

    assert aliases.best_alias(q, a).columns == ["q", "best"] and aliases.best_alias(q, a).count() == 5
    assert rows(aliases.resolve_alias(q, a), "query_id", "q", "nick", "targets") == sorted((i, t, *best(t)) for i, t in asked)
    none = spark.createDataFrame([], "term string, concept_id string")
    got = rows(aliases.expand_terms(q, a, none, spark.createDataFrame([], "phrase string, ord int, targets array<string>")), "query_id", "ord", "term")
    for i, text in asked[:7]:
        targets = best(text)[1] or []
        canonical = targets[0] if len(targets) == 1 else text
        nicks = sorted(n for n, ts, _ in table for t in ts if canonical and t.lower() == canonical.lower() and n.lower() not in canonical.lower())
        first = {}
        for t in [text, canonical, *sorted(targets), *nicks] if text else []:
            first.setdefault(t.lower(), t)
        assert [t for j, _, t in got if j == i] == list(first.values())
    assert len({j for j, _, _ in got}) == 2400


def test_terms_of_several_words_meet_blocks_by_two_words(spark):
    """Terms that share a frequent first word reach only the blocks that hold two of their words side by side, with or without gaps."""
    texts = [f"the w{i} and the·w{i + 1} or thew{i + 2}" for i in range(60)] + ["a b c", "ab c", "a bc", "abc", "a b x c", "one two three four five six seven eight", "onetwo three fourfive six seven eight", "one two"]
    b = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, ord int, text string")
    t = spark.createDataFrame([(i, f"the w{i}") for i in range(60)] + [(100, "a b c"), (101, "one two three four five six seven eight"), (102, "three four five")], "query_id long, term string")
    scan, index = (rows(f(t, b), "query_id", "doc", "n", "positions") for f in (occurrences.scan_occurrences, occurrences.index_occurrences))
    assert scan == index and {d for q, d, *_ in index if q == 100} == {60, 61, 62, 63} and {d for q, d, *_ in index if q > 100} == {65, 66}
    assert occurrences.near_blocks(t, b).count() < 200 < occurrences.near_blocks(t, b, occurrences.block_grams(b)).count()


def test_targets_join_where_variants_are_used(spark, monkeypatch):
    """A nick of many targets, equal queries in several parts: the variants of a plain reading; targets are not sent on once for every query."""
    monkeypatch.setattr(aliases, "DEALT", 3)
    many = [f"T{i}" for i in range(30)] + ["t7", "peer"]
    a = spark.createDataFrame([("big", many, 1), ("nick", ["one"], 2), ("xy", ["ONE", "two"], 3)], "nick string, targets array<string>, priority int")
    asked = [(i, ["big", "BIG", "t7", "nick", "one", "none", " ", None][i % 8]) for i in range(64)]
    q = spark.createDataFrame(asked, "query_id long, q string")
    concepts = spark.createDataFrame([("One", "c"), ("uno", "c"), ("big", "d"), ("PEER", "d")], "term string, concept_id string")
    found = aliases.expand_terms(q, a, concepts, spark.createDataFrame([("bi", 1, ["big", "bike"])], "phrase string, ord int, targets array<string>"))
    assert "explode(targets" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {i: [] for i, _ in asked}
    for i, _, t, branch in rows(found, "query_id", "ord", "term", "branch"):
        got[i].append((t, branch))
    ordered = [f"T{i}" for i in sorted(range(30), key=str)] + ["peer"]
    targets = [(t, 2) for t in ordered if t != "T7"]
    true = {
        "big": [("big", 0), *sorted([("T7", 2), *targets]), ("bike", 3)], "BIG": [("BIG", 0), *sorted([("T7", 2), *targets])], "t7": [("t7", 0), *targets, ("big", 5)],
        "nick": [("nick", 0), ("one", 1), ("uno", 4), ("xy", 5)], "one": [("one", 0), ("uno", 4), ("nick", 5), ("xy", 5)], "none": [("none", 0)], " ": [], None: [],
    }
    assert got == {i: true[t] for i, t in asked}
