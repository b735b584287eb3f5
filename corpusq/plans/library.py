"""Queries over texts, glossary cards, stories, pages, questions and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.operators import blocks as bl
from corpusq.operators import dedupe, quality
from corpusq.operators import glossary as gl
from corpusq.operators import qa as qa_ops
from corpusq.operators import snippets as sn
from corpusq.operators import story as st
from corpusq.operators.occurrences import occurrences
from corpusq.plans import tables as tb
from corpusq.plans.registry import Catalog
from corpusq.plans.tables import sql
from corpusq.sources import ingest

C = Catalog()


def _docs(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", "text", "source", "lang")


# Texts


@C.add(sql(select="SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) < 40 OR regexp_matches(substr(text, 1, 60), '与月姬正篇无关|详细请参照|参照用语|见下文|参见用语') AS placeholder, length(regexp_replace(text, '[\\s…。！？!?，,、；;：:（）()《》〈〉「」『』\\[\\]【】—－\\-/／·・.．\"''“”‘’]+', '', 'g')) >= 12 AS long_enough, regexp_matches(text, '(?i)<a\\b|<br\\b|https?://|www\\.|\\]\\(http') AS markup FROM documents"))
def text_predicates(spark, d):
    """P10, P15, P18."""
    t = F.col("text")
    return _docs(spark, d).select("doc_id", tx.is_placeholder(t).alias("placeholder"), tx.snippet_long_enough(t).alias("long_enough"), tx.has_markup(t).alias("markup"))


@C.add(sql(tb.SQL_BLOCKS, select="SELECT doc, ord, regexp_matches(text, '^\\s*(?:出处|来源|原文|网址|链接|译者|翻译|录入|校对|扫图|修图|发布|资源|原帖|转载|作者)\\s*[:：]') AS noise, regexp_matches(text, '(?i)^\\s*(?:[-=*#_;・·—]{4,}|(?:goto|return|if|mov|numalias|effect|textgosub|ruby|select|clickstr|menusetwindow|menuselectcolor|savenumber|savename)\\b)') AS control, regexp_matches(text, '^(解说|插画|插图)') AS excluded FROM blocks"))
def line_predicates(spark, d):
    """P14, P16."""
    t = F.col("text")
    return tb.blocks(spark, d).select("doc", "ord", tx.is_noise_line(t).alias("noise"), tx.is_control_line(t).alias("control"), tx.is_excluded_section(t).alias("excluded"))


@C.add(sql(select="SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '(?is)<a\\b[^>]*>(.*?)</a>', '\\1', 'g'), '<[^>]+>', '', 'g'), chr(10)), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '(?i)(?:https?://|www\\.)[^\\s<>\"“”]+', '', 'g'), '[\\x00-\\x1f]', '', 'g'), '[ 　]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS text FROM pages"))
def clean_text(spark, d):
    """cleaned text of every page."""
    return tb.table(spark, d, "pages").select("page_id", tx.clean_text(F.col("html")).alias("text"))


@C.add(sql(select="SELECT doc_id, lower(regexp_replace(text, '[\\s　]+', '', 'g')) AS match_key, regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g') AS skeleton, sha256(text) AS hash, lower(regexp_replace(text, '[\\s。！？!?，,、；;：:（）()《》〈〉「」『』\\[\\]【】…—\\-]+', '', 'g')) AS fingerprint FROM documents"))
def text_keys(spark, d):
    """keys under which texts are compared."""
    t = F.col("text")
    return _docs(spark, d).select("doc_id", tx.match_key(t).alias("match_key"), tx.definition_skeleton(t).alias("skeleton"), F.sha2(F.encode(t, "UTF-8"), 256).alias("hash"), tx.qa_fingerprint(t).alias("fingerprint"))


@C.add(sql(tb.SQL_DOCS, select="SELECT doc, upper(regexp_replace(regexp_extract(file, '([^/]*)$', 1), '[^\\p{L}\\p{N}]', '', 'g')) AS stem, regexp_replace(title, '[\\\\/:*?\"<>|\\n\\t]+', '_', 'g') AS safe, work || ' › ' || kind || ' › ' || doc AS path FROM docs"))
def path_keys(spark, d):
    """keys of paths."""
    x = tb.docs(spark, d)
    safe = F.regexp_replace("title", "[\\\\/:*?\"<>|\\n\\t]+", "_")
    return x.select("doc", tx.stem_key(F.col("file")).alias("stem"), safe.alias("safe"), tx.path_of(F.col("work"), F.col("kind"), F.lit(""), F.col("work"), F.col("doc").cast("string")).alias("path"))


@C.add(sql(select="SELECT doc_id, regexp_replace(text, '(?i)(the|der)', '<mark>\\1</mark>', 'g') AS marked, replace(replace(text, 'the', 'THE'), 'THE and', 'both') AS replaced FROM documents"))
def highlight(spark, d):
    """Marks and ordered replacements."""
    rules = F.array(F.struct(F.lit("the").alias("src"), F.lit("THE").alias("dst")), F.struct(F.lit("THE and").alias("src"), F.lit("both").alias("dst")))
    return _docs(spark, d).select("doc_id", tx.highlight(F.col("text"), "(?i)(the|der)").alias("marked"), tx.replace_all(F.col("text"), rules).alias("replaced"))


@C.add(sql(select="SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_type || ' ' || p_size), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 12, '0') ELSE x END), '') AS natural_key FROM part"))
def natural_order(spark, d):
    """F17."""
    return tb.table(spark, d, "part").select("p_partkey", tx.natural_key(F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))).alias("natural_key"))


@C.add(sql(select="SELECT s_suppkey, replace(s_name, '#', ' #') || ' Part II' AS text, '' AS notes, replace(replace(s_name, '#', ' #'), ' ', '') || 'PartII' AS key FROM supplier"))
def normalized_queries(spark, d):
    """NFKC form, replaced spellings and glossary keys of names with full-width letters and Roman numerals."""
    wide = F.translate(F.concat(F.lit("Part "), F.lit("Ⅱ")), "Part", "Ｐａｒｔ")
    name = F.concat(F.replace("s_name", F.lit("#"), F.lit(" #")), F.lit(" "), wide)
    n = tx.normalize_query_text(name)
    return tb.table(spark, d, "supplier").select("s_suppkey", n["text"].alias("text"), F.array_join(n["notes"], "|").alias("notes"), tx.term_key(name).alias("key"))


@C.add(sql(tb.SQL_BLOCKS, select="SELECT doc, ord, CASE WHEN p > 121 THEN '…' ELSE '' END || trim(regexp_replace(regexp_replace(regexp_replace(substr(text, greatest(1, p - 120), least(length(text), p + 119) - greatest(0, p - 121)), '(?i)<img[^>]*>', '', 'g'), '\\n', ' ', 'g'), ' +', ' ', 'g'), ' ') || CASE WHEN p + 119 < length(text) THEN '…' ELSE '' END AS snippet FROM (SELECT *, strpos(lower(text), 'license') AS p FROM blocks) WHERE p > 0"))
def text_snippets(spark, d):
    """One line around the first place of a word."""
    b = tb.blocks(spark, d).withColumn("p", F.instr(F.lower("text"), "license")).where("p > 0")
    return b.select("doc", "ord", sn.text_snippet(F.col("text"), F.col("p") - 1).alias("snippet"))


@C.add()
def sentence_snippets(spark, d):
    """Sentence windows of the first hit of each block."""
    h = occurrences(tb.terms(spark, [(6, "license")]), tb.blocks(spark, d)).join(tb.blocks(spark, d), ["doc", "ord"])
    s = sn.sentence_snippet("text", F.get("positions", F.lit(0)), F.get("positions", F.lit(0)) + 7)
    return h.select("doc", "ord", s["start"].alias("start"), s["end"].alias("end"))


@C.add()
def paragraph_snippets(spark, d):
    """Paragraph windows with neighbours."""
    h = occurrences(tb.terms(spark, [(6, "license")]), tb.blocks(spark, d))
    h = h.select("query_id", "doc", "ord", F.get("positions", F.lit(0)).alias("start"), (F.get("positions", F.lit(0)) + 7).alias("end"))
    return sn.with_snippets(h, tb.blocks(spark, d))


# Glossary


@C.add(sql(tb.SQL_ENTRIES, select="SELECT term, entry_id, row_number() OVER (PARTITION BY term ORDER BY length(regexp_replace(body, '\\s+', '', 'g')) < 40, -definition_quality, -length(body), entry_id) AS place FROM entries"))
def entry_rank(spark, d):
    """Order of the entries of a term."""
    from pyspark.sql import Window

    e = tb.entries(spark, d)
    w = Window.partitionBy("term").orderBy(gl.entry_rank(F.col("body"), F.col("definition_quality")), "entry_id")
    return e.select("term", "entry_id", F.row_number().over(w).alias("place"))


RANKED = "e AS (SELECT *, CASE cat WHEN 'en' THEN 0 ELSE 1 END AS priority, length(body) % 3 AS kind_rank FROM entries)"


def _leaf_entries(spark, d):
    return tb.entries(spark, d).withColumns({"priority": F.when(F.col("cat") == "en", 0).otherwise(1), "kind_rank": F.length("body") % 3})


@C.add(sql(tb.SQL_ENTRIES, RANKED, select="SELECT leaf, term, entry_id, count(*) OVER (PARTITION BY leaf, term) AS entries FROM e QUALIFY row_number() OVER (PARTITION BY leaf, term ORDER BY priority, kind_rank, entry_id) = 1"))
def leaf_best_entry(spark, d):
    """A09."""
    return gl.leaf_terms(_leaf_entries(spark, d)).select("leaf", "term", "entry_id", "entries")


@C.add(sql(tb.SQL_ENTRIES, select="SELECT term, array_to_string(list(DISTINCT leaf ORDER BY leaf), '|') AS leaves, count(*) AS entries FROM entries GROUP BY term"))
def term_leaves(spark, d):
    """A10."""
    t = gl.term_leaves(tb.entries(spark, d))
    return t.select("term", F.array_join("leaves", "|").alias("leaves"), F.size("entry_ids").alias("entries"))


@C.add(sql(tb.SQL_ENTRIES, "t AS (SELECT leaf, term, count(*) AS n, min(cat) AS cat FROM entries GROUP BY ALL)", select="SELECT leaf, term, n, row_number() OVER (PARTITION BY leaf ORDER BY CASE cat WHEN 'en' THEN 0 ELSE 30 END, n DESC, length(term), term) AS place FROM t"))
def leaf_order(spark, d):
    """Terms of a leaf in order."""
    t = tb.entries(spark, d).groupBy("leaf", "term").agg(F.count("*").alias("n"), F.min("cat").alias("cat"))
    return gl.leaf_order(t.withColumn("cat_rank", F.when(F.col("cat") == "en", 0).otherwise(30))).select("leaf", "term", "n", "place")


@C.add(sql(tb.SQL_ENTRIES, """few AS (SELECT *, row_number() OVER (PARTITION BY group_id, meaning_id ORDER BY is_primary DESC, length(regexp_replace(body, '\\s+', '', 'g')) < 40, -definition_quality, -length(body), entry_id) AS place FROM entries QUALIFY place <= 3)""", select="SELECT group_id, meaning_id, entry_id, place FROM few QUALIFY row_number() OVER (PARTITION BY group_id, body ORDER BY meaning_id, place) = 1"))
def meaning_cards(spark, d):
    """Variants of each meaning, each body once in its group."""
    return gl.meaning_cards(tb.entries(spark, d)).select("group_id", "meaning_id", "entry_id", "place")


GRAMS = """skel AS (SELECT group_id, card_id, forced, body, definition_quality, is_primary, version, bucket, lower(regexp_replace(body, '[^\\p{L}\\p{N}]+', '', 'g')) AS s FROM entries),
    cards AS (SELECT *, length(s) AS size, list_distinct(list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: substr(s, i, 3))) AS grams FROM skel),
    pairs AS (SELECT a.group_id, a.card_id AS a, b.card_id AS b, a.size AS na, b.size AS nb, a.grams AS ga, b.grams AS gb, a.bucket AS ba, b.bucket AS bb, len(list_intersect(a.grams, b.grams)) AS shared FROM cards a JOIN cards b ON a.group_id = b.group_id AND a.card_id < b.card_id),
    cov AS (SELECT group_id, CASE WHEN na > nb THEN b ELSE a END AS short, CASE WHEN na > nb THEN a ELSE b END AS long, least(na, nb) AS n_short, shared / greatest(1, len(CASE WHEN na > nb THEN gb ELSE ga END)) AS share, ba = bb AS together FROM pairs
        WHERE least(na, nb) >= 40 AND greatest(na, nb) >= CAST(1.35 AS DOUBLE) * least(na, nb) AND shared / greatest(1, len(CASE WHEN na > nb THEN gb ELSE ga END)) >= 0.7)"""


@C.add(sql(tb.SQL_ENTRIES, GRAMS, select="SELECT group_id, a, b, shared / greatest(1, len(ga) + len(gb) - shared) AS similarity FROM pairs WHERE least(na, nb) >= CAST(0.85 AS DOUBLE) * greatest(na, nb) AND shared / greatest(1, len(ga) + len(gb) - shared) >= 0.7"))
def duplicate_cards(spark, d):
    """Near-duplicate pairs by n-grams, a cheaper measure than matching blocks."""
    return gl.duplicate_pairs(tb.entries(spark, d))


@C.add(sql(tb.SQL_ENTRIES, GRAMS, select="SELECT group_id, short, long, n_short, share FROM cov"))
def coverage_ngram(spark, d):
    """Cards whose n-grams a longer one holds, a cheaper measure than matching blocks."""
    return gl.coverage(tb.entries(spark, d).drop("bucket"))


LINKED = """dup AS (SELECT a, b FROM pairs WHERE least(na, nb) >= CAST(0.85 AS DOUBLE) * greatest(na, nb) AND shared / greatest(1, len(ga) + len(gb) - shared) >= 0.7),
    edge AS (SELECT a, b FROM dup UNION ALL SELECT b, a FROM dup), reach AS (SELECT card_id, card_id AS via FROM cards UNION SELECT r.card_id, e.b FROM reach r JOIN edge e ON r.via = e.a),
    clus AS (SELECT card_id, min(via) AS cluster FROM reach GROUP BY card_id)"""


# Matching blocks are not a matter of SQL: the tests hold these queries against a plain reading of all groups.


@C.add()
def matching_duplicates(spark, d):
    """Near-duplicate pairs by matching blocks."""
    return gl.matching_pairs(tb.entries(spark, d))


@C.add()
def matching_coverage(spark, d):
    """Cards that a much longer one covers by matching blocks."""
    return gl.matching_coverage(tb.entries(spark, d).drop("bucket"))


@C.add()
def prune_covered(spark, d):
    """Without the cards that one of their version bucket covers."""
    return gl.prune_covered(tb.entries(spark, d)).select("group_id", "card_id")


@C.add()
def assemble_cards(spark, d):
    """Primary card, from the normal versions where there are both, and order of the rest."""
    return gl.assemble_cards(tb.entries(spark, d)).select("group_id", "card_id", "chars_covered", "place")


@C.add()
def duplicate_clusters(spark, d):
    """Transitive groups of near duplicates."""
    e = tb.entries(spark, d)
    return gl.clusters(e, gl.matching_pairs(e))


@C.add()
def dedupe_cards(spark, d):
    """The best card of each cluster."""
    e = tb.entries(spark, d)
    return gl.dedupe_cards(e, gl.matching_pairs(e)).select("card_id", "cluster")


@C.add("WITH RECURSIVE " + ",\n".join([tb.SQL_ENTRIES, GRAMS, LINKED]) + " SELECT card_id, cluster FROM clus")
def ngram_clusters(spark, d):
    """Transitive groups of pairs by n-grams."""
    e = tb.entries(spark, d)
    return gl.clusters(e, gl.duplicate_pairs(e))


@C.add(sql(tb.SQL_ENTRIES, "f AS (SELECT group_id, cat AS flag, min(entry_id) AS first FROM entries GROUP BY ALL)", select="SELECT group_id, array_to_string(list(flag ORDER BY first), '|') AS flags FROM f GROUP BY group_id"))
def conflict_flags(spark, d):
    """Flags of a group in order."""
    e = tb.entries(spark, d).withColumn("conflict_flags", F.array("cat"))
    return gl.conflict_flags(e).withColumn("flags", F.array_join("flags", "|"))


@C.add(sql(tb.SQL_ENTRIES, select="SELECT group_id, sum((cat = 'en')::INT) * 2 > count(*) AS majority FROM entries GROUP BY group_id"))
def majority(spark, d):
    """A17."""
    return gl.majority(tb.entries(spark, d), F.col("cat") == "en", ["group_id"])


NAMES = [(1, "attion"), (2, "er"), (3, "therein"), (4, "license")]
MATCHED = f"""q AS (SELECT * FROM {tb.values(NAMES)} v(query_id, q)),
    m AS (SELECT query_id, q, entry_id, group_id, term, body, CASE cat WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS family, count(*) OVER (PARTITION BY query_id, term) AS freq, CASE WHEN term = q THEN 0 WHEN starts_with(term, q) THEN 1 WHEN regexp_matches(lower(body), '(^|[^a-z0-9])' || q || '([^a-z0-9]|$)') THEN 2 END AS bucket FROM q, entries),
    hit AS (SELECT * FROM m WHERE bucket IS NOT NULL)"""


def _matched(spark, d):
    e = tb.entries(spark, d)
    q = tb.asked(spark, NAMES)
    return gl.match_entries(q, e.select("entry_id", "term", "body")).join(q, "query_id").join(e.select("entry_id", "group_id", "term", "body"), "entry_id")


@C.add(sql(tb.SQL_ENTRIES, MATCHED, select="SELECT query_id, entry_id, CASE bucket WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' ELSE 'body' END AS match FROM hit"))
def match_entries(spark, d):
    """Entries by name and by body."""
    return _matched(spark, d).select("query_id", "entry_id", "match")


ORDERED = """keyed AS (SELECT *, CASE bucket WHEN 0 THEN (length(regexp_replace(body, '\\s+', '', 'g')) < 40)::INT WHEN 1 THEN -freq ELSE -len(regexp_extract_all(lower(body), q)) END AS k1, CASE bucket WHEN 0 THEN -length(body) WHEN 1 THEN (NOT starts_with(term, q))::INT ELSE length(body) END AS k2 FROM hit),
    one AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY query_id, group_id ORDER BY bucket, family, k1, k2, length(term), entry_id) = 1),
    ranked AS (SELECT query_id, entry_id, CASE bucket WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' ELSE 'body' END AS match, row_number() OVER (PARTITION BY query_id ORDER BY bucket, family, k1, k2, length(term), entry_id) AS place FROM one)"""


def _ranked(spark, d):
    e = tb.entries(spark, d)
    family = F.when(F.col("cat") == "en", 0).when(F.col("cat") == "de", 1).otherwise(2)
    known = e.select("entry_id", family.alias("family"), "term").join(e.groupBy("term").agg(F.count("*").alias("freq")), "term").drop("term")
    return gl.rank_definitions(_matched(spark, d).join(known, "entry_id"))


@C.add(sql(tb.SQL_ENTRIES, MATCHED, ORDERED, select="SELECT * FROM ranked"))
def rank_definitions(spark, d):
    """Definitions of each query, one per group."""
    return _ranked(spark, d).select("query_id", "entry_id", "match", "place")


@C.add(sql(tb.SQL_ENTRIES, MATCHED, ORDERED, select="SELECT query_id, entry_id, match, card FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS card FROM (SELECT *, row_number() OVER (PARTITION BY query_id, match ORDER BY place) AS i FROM ranked) WHERE match = 'exact' OR i <= CASE match WHEN 'contains' THEN 10 ELSE 6 END) WHERE card <= 26"))
def cap_cards(spark, d):
    """W16."""
    return gl.cap_cards(_ranked(spark, d)).select("query_id", "entry_id", "match", "card")


@C.add(sql(tb.SQL_ENTRIES, MATCHED, select="SELECT query_id, entry_id FROM hit QUALIFY rank() OVER (PARTITION BY query_id ORDER BY bucket) = 1"))
def first_non_empty(spark, d):
    """The first kind of match that has rows."""
    part = F.when(F.col("match") == "exact", 0).when(F.col("match") == "contains", 1).otherwise(2)
    return gl.first_non_empty(_matched(spark, d).withColumn("part_ord", part)).select("query_id", "entry_id")


@C.add(sql(tb.SQL_ENTRIES, select="SELECT entry_id, CASE WHEN term = 'attion' AND doc % 2 = 0 THEN 'see: ' || body ELSE body END AS body FROM entries"))
def override_bodies(spark, d):
    """F26."""
    e = tb.entries(spark, d)
    o = e.where("term = 'attion' and doc % 2 = 0").select("term", "doc", F.lit("see: ").alias("prefix"), F.lit(None).cast("string").alias("replacement"))
    return gl.override_bodies(e, o).select("entry_id", "body")


# Stories and pages


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_CHAPTERS, select="SELECT doc, start, lead(start) OVER (PARTITION BY doc ORDER BY start) AS \"end\" FROM chapters"))
def close_ranges(spark, d):
    """W03."""
    return st.close_ranges(tb.chapters(spark, d)).select("doc", "start", "end")


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_CHAPTERS, "c AS (SELECT doc, start, doc || ':' || start AS key FROM chapters)", select="SELECT doc, key, lag(key) OVER w AS prev_key, lead(key) OVER w AS next_key, row_number() OVER w AS idx, count(*) OVER (PARTITION BY doc) AS total FROM c WINDOW w AS (PARTITION BY doc ORDER BY start)"))
def chapter_nav(spark, d):
    """W02."""
    c = tb.chapters(spark, d).select("doc", F.col("start").alias("ord"), F.concat_ws(":", F.col("doc").cast("string"), F.col("start").cast("string")).alias("key"))
    return st.chapter_nav(c, "doc").drop("ord")


@C.add(sql(tb.SQL_DOCS, select="SELECT doc, work || '::' || CASE WHEN kind = 'en' THEN 'root' ELSE kind END || '::' || (row_number() OVER (PARTITION BY work, CASE WHEN kind = 'en' THEN 'root' ELSE kind END ORDER BY doc) - 1) AS key FROM docs"))
def chapter_keys(spark, d):
    """W19."""
    c = tb.docs(spark, d).select("doc", "work", F.when(F.col("kind") != "en", F.col("kind")).alias("route"), F.col("doc").alias("ord"))
    return st.assign_keys(c).select("doc", "key")


INTERVALS = "loc AS (SELECT doc, start + 1 AS start, lead(start) OVER (PARTITION BY doc ORDER BY start) AS stop, title AS path FROM chapters)"


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_CHAPTERS, INTERVALS, select="SELECT b.doc, ord, path FROM blocks b LEFT JOIN loc l ON b.doc = l.doc AND ord >= start AND (stop IS NULL OR ord < stop)"))
def locate_blocks(spark, d):
    """Half-open intervals; a chapter's first block has none here."""
    loc = st.close_ranges(tb.chapters(spark, d)).select("doc", (F.col("start") + 1).alias("start"), "end", F.col("title").alias("path"))
    return st.locate(tb.blocks(spark, d), loc).select("doc", "ord", "path")


@C.add(sql(tb.SQL_BLOCKS, "c AS (SELECT doc, ord AS start, substr(text, 1, 20) AS title FROM blocks WHERE ord % 10 = 3)", "l AS (SELECT *, lead(start) OVER (PARTITION BY doc ORDER BY start) AS stop FROM c)", select="SELECT b.doc, ord, coalesce(l.title, (SELECT arg_min(title, start) FROM c WHERE c.doc = b.doc)) AS chapter FROM blocks b LEFT JOIN l ON b.doc = l.doc AND ord >= start AND (stop IS NULL OR ord < stop)"))
def chapter_of(spark, d):
    """Clamped outside the first and last chapter."""
    b = tb.blocks(spark, d)
    c = b.where("ord % 10 = 3").select("doc", F.col("ord").alias("start"), F.substring("text", 1, 20).alias("title"))
    return st.chapter_of(b, c).select("doc", "ord", "chapter")


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_LOCATED, "f AS (SELECT *, CASE WHEN lag(path) OVER w = path AND lag(ord) OVER w = ord - 1 THEN 0 ELSE 1 END AS f FROM located WINDOW w AS (PARTITION BY doc ORDER BY ord))", "r AS (SELECT *, sum(f) OVER (PARTITION BY doc ORDER BY ord) AS run FROM f)", select="SELECT doc, path, min(ord) AS start, max(ord) + 1 AS \"end\" FROM r GROUP BY doc, run, path"))
def compact_locations(spark, d):
    """Gaps and islands."""
    return st.compact_locations(tb.located(spark, d))


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_LOCATED, tb.SQL_DOCS, """src AS (SELECT kind AS work, doc, ord, path, regexp_replace(text, '\\s+', '', 'g') AS flat FROM located JOIN docs USING (doc)),
    idx AS (SELECT work, piece, min(path) AS path FROM (SELECT work, path, unnest(list_transform(range(0, length(flat) - 40, 160), lambda k: substr(flat, k + 1, 40))) AS piece FROM src WHERE doc % 2 = 0 AND length(flat) > 40) GROUP BY ALL),
    probe AS (SELECT work, doc, ord, unnest(range(0, length(flat) - 39, 20)) AS k, unnest(list_transform(range(0, length(flat) - 39, 20), lambda k: substr(flat, k + 1, 40))) AS piece FROM src WHERE doc % 2 = 1 AND length(flat) >= 40)""", select="SELECT doc, ord, arg_min(path, k) AS path FROM probe JOIN idx USING (work, piece) GROUP BY doc, ord"))
def shingle_path(spark, d):
    """Paths by 40-character pieces."""
    b = tb.located(spark, d).join(tb.docs(spark, d).select("doc", F.col("kind").alias("work")), "doc")
    return st.path_by_shingle(b.where("doc % 2 = 1"), b.where("doc % 2 = 0"))


@C.add(sql(tb.SQL_BLOCKS, "c AS (SELECT doc, ord, CASE WHEN ord % 4 = 0 THEN ord END AS start FROM blocks WHERE ord % 2 = 0)", select="SELECT doc, ord, coalesce(first_value(start IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(ord) OVER (PARTITION BY doc)) AS start FROM c"))
def resolve_starts(spark, d):
    """W12."""
    c = tb.blocks(spark, d).where("ord % 2 = 0").select("doc", "ord", F.when(F.col("ord") % 4 == 0, F.col("ord")).alias("start"))
    return st.resolve_starts(c, c.groupBy("doc").agg(F.max("ord").alias("last_ord")))


@C.add(sql(tb.SQL_BLOCKS, "i AS (SELECT doc, ord, len < 150 AS candidate, row_number() OVER (PARTITION BY doc ORDER BY ord) AS idx FROM blocks)", "r AS (SELECT doc, ord, idx - row_number() OVER (PARTITION BY doc ORDER BY ord) AS island FROM i WHERE candidate)", "s AS (SELECT doc, island, min(ord) AS start, count(*) AS size FROM r GROUP BY ALL)", select="SELECT doc, start, size FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY size DESC, start) = 1"))
def longest_run(spark, d):
    """W09."""
    return st.longest_run(tb.blocks(spark, d).withColumn("candidate", F.col("len") < 150))


@C.add(sql(tb.SQL_BLOCKS, "m AS (SELECT doc, ord, text, min(CASE WHEN regexp_matches(text, 'the') THEN ord END) OVER (PARTITION BY doc) AS a FROM blocks)", "z AS (SELECT *, min(CASE WHEN regexp_matches(text, '[?]') AND ord > a THEN ord END) OVER (PARTITION BY doc) AS b FROM m)", select="SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS n FROM z WHERE ord >= a AND (b IS NULL OR ord < b)"))
def slice_between(spark, d):
    """W11."""
    return st.slice_between(tb.blocks(spark, d), "the", "[?]").select("doc", "ord", "n")


PAGE = """tagless AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<!--.*?-->', '', 'g') AS h FROM pages),
    cut AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '(?i)<(h[1-3]|p|blockquote)\\b', chr(1) || '<\\1', 'g'), '(?i)</(h[1-3]|p|blockquote)>', chr(2), 'g'), chr(1))[2:] AS parts FROM tagless),
    raw AS (SELECT page_id, unnest(range(len(parts))) AS ord, unnest(list_transform(parts, lambda x: string_split(x, chr(2))[1])) AS raw FROM cut),
    page_blocks AS (SELECT page_id, ord, CASE WHEN regexp_matches(raw, '(?i)^<h[1-3]') THEN 'heading' WHEN regexp_matches(raw, '(?i)^<blockquote') THEN 'quote' ELSE 'paragraph' END AS kind,
        regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(raw, '(?i)<br\\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g') AS text FROM raw)"""


@C.add(sql(PAGE, select="SELECT page_id, ord, kind, text FROM page_blocks WHERE text <> ''"))
def page_blocks(spark, d):
    """Headings and paragraphs of pages."""
    return tb.pages_as_blocks(spark, d)


@C.add(sql(PAGE, "t AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord) AS title FROM page_blocks WHERE text <> '')", select="SELECT page_id AS doc, title, count(*) AS paragraphs, string_agg(text, chr(10) ORDER BY ord) AS text FROM t WHERE kind <> 'heading' AND title IS NOT NULL GROUP BY ALL"))
def assign_chapters(spark, d):
    """Paragraphs of pages under their headings."""
    b = tb.pages_as_blocks(spark, d).withColumnRenamed("page_id", "doc")
    return st.chapter_texts(st.assign_chapters(b))


@C.add(sql(PAGE, "a AS (SELECT page_id, sum(length(text)) AS parsed, page_id % 9 AS volume FROM page_blocks WHERE text <> '' GROUP BY page_id)", "n AS (SELECT volume, page_id AS doc, CAST(parsed AS BIGINT) AS parsed, length(html) AS declared, row_number() OVER (PARTITION BY volume ORDER BY page_id) AS n FROM a JOIN pages USING (page_id))", select="SELECT volume, doc, parsed, declared, round(abs(parsed - declared) / greatest(1, declared), 4) AS diff, abs(parsed - declared) / greatest(1, declared) <= CASE WHEN n = 1 THEN 0.07 ELSE 0.02 END AS ok FROM n"))
def coverage_audit(spark, d):
    """A26."""
    a = tb.pages_as_blocks(spark, d).groupBy("page_id").agg(F.sum(F.length("text")).alias("parsed")).join(tb.table(spark, d, "pages"), "page_id")
    return st.coverage_audit(a.select((F.col("page_id") % 9).alias("volume"), F.col("page_id").alias("doc"), "parsed", F.lit(0).alias("excluded"), F.length("html").cast("long").alias("declared")))


@C.add(sql(select="SELECT r_name AS work, n_name AS route, row_number() OVER (PARTITION BY r_name, n_name ORDER BY c_custkey) - 1 AS ord, c_name AS title, c_custkey AS doc FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"))
def flatten_story(spark, d):
    """A nested tree of works, routes and chapters made flat."""
    c = tb.table(spark, d, "customer").select("c_nationkey", F.struct(F.col("c_custkey").alias("doc"), F.col("c_name").alias("title"), F.lit(0).alias("start"), F.lit(None).cast("int").alias("end")).alias("c"))
    n = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c")).alias("chapters")).join(tb.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), "chapters"))).alias("routes")).join(tb.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    story = w.select(F.col("r_name").alias("work"), F.expr("cast(array() as array<struct<doc:bigint,title:string,start:int,end:int>>)").alias("root_chapters"), "routes")
    return st.flatten_story(story).select("work", "route", "ord", "title", "doc")


@C.add(sql(tb.SQL_DOCS, select="SELECT doc, doc % 7 AS node, row_number() OVER (PARTITION BY doc % 7 ORDER BY shown IS NOT NULL, CASE WHEN shown IS NOT NULL THEN first END, doc) AS group_place FROM (SELECT doc, CASE WHEN doc % 3 > 0 THEN work END AS shown, min(doc) OVER (PARTITION BY doc % 7, CASE WHEN doc % 3 > 0 THEN work END) AS first FROM docs)"))
def order_groups(spark, d):
    """W20."""
    r = tb.docs(spark, d).select("doc", (F.col("doc") % 7).alias("node"), F.col("doc").alias("idx"), F.when(F.col("doc") % 3 > 0, F.col("work")).alias("grp"))
    return st.order_groups(r).select("doc", "node", "group_place")


@C.add(sql(tb.SQL_DOCS, "o AS (SELECT work, doc FROM docs QUALIFY row_number() OVER (PARTITION BY work, title ORDER BY doc) = 1)", select="SELECT work, doc, row_number() OVER (PARTITION BY work ORDER BY doc) AS n, lpad((row_number() OVER (PARTITION BY work ORDER BY doc))::VARCHAR, 3, '0') AS prefix FROM o"))
def number_rows(spark, d):
    """First row of each key, numbered with a padded prefix."""
    return st.number_rows(tb.docs(spark, d), "title", "doc").select("work", "doc", "n", "prefix")


@C.add(sql(tb.SQL_BLOCKS, select="SELECT doc, ord, 'main' AS lang, text FROM blocks WHERE ord % 2 = 0 UNION ALL SELECT doc, ord, 'other', reverse(text) FROM blocks WHERE ord % 4 = 0"))
def doc_view(spark, d):
    """Two languages side by side."""
    b = tb.blocks(spark, d)
    own = b.where("ord % 2 = 0").select("doc", "ord", F.lit("main").alias("lang"), "text")
    return st.doc_view(own, b.where("ord % 4 < 2 and ord % 4 <> 1").select("doc", "ord", F.lit("other").alias("lang"), F.reverse("text").alias("text")))


@C.add(sql(tb.SQL_DOCS, select="SELECT doc FROM docs WHERE work IN (SELECT work FROM docs WHERE kind = 'de') AND doc % 5 > 0 AND doc % 7 > 0"))
def missing_chapters(spark, d):
    """U04, U05, Q07."""
    x = tb.docs(spark, d)
    expected = x.join(x.where("kind = 'de'").select("work").distinct(), "work", "left_semi").select(F.col("doc").alias("chapter"))
    key = x.select(F.col("doc").alias("chapter"))
    return st.missing_chapters(expected, key.where("chapter % 5 = 0"), key.where("chapter % 7 = 0")).withColumnRenamed("chapter", "doc")


@C.add(sql(select="SELECT s_suppkey AS doc, s_name AS file, false AS fresh FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 3 = 0) + row_number() OVER (ORDER BY s_name), s_name, true FROM supplier WHERE s_suppkey % 3 > 0"))
def upsert_ids(spark, d):
    """Ids for unseen files."""
    s = tb.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), F.col("s_name").alias("file"))
    return ingest.upsert_docs(s.where("doc % 3 = 0"), s)


@C.add(sql(tb.SQL_DOCS, select="SELECT doc, file, CASE WHEN doc % 4 = 0 THEN NULL WHEN doc % 2 = 0 THEN 'a/' || file ELSE 'b/' || file END AS path FROM docs"))
def resolve_sources(spark, d):
    """First root that has the file."""
    x = tb.docs(spark, d)
    a = x.where("doc % 2 = 0 and doc % 4 > 0").select("file", F.concat(F.lit("a/"), "file").alias("path"), F.lit(0).alias("priority"))
    b = x.where("doc % 4 > 0").select("file", F.concat(F.lit("b/"), "file").alias("path"), F.lit(1).alias("priority"))
    return ingest.resolve_sources(x, a.unionByName(b)).select("doc", "file", "path")


@C.add(sql(select="SELECT e.user_id AS part, e.event_id AS pos, max(s.event_id) AS start FROM events e LEFT JOIN events s ON s.user_id = e.user_id AND s.event_id <= e.event_id AND s.event_type = 'click' GROUP BY ALL"))
def asof_segment(spark, d):
    """Greatest start at or before a position."""
    e = tb.table(spark, d, "events")
    return bl.asof_segment(e.select(F.col("user_id").alias("part"), F.col("event_id").alias("pos")), e.where("event_type = 'click'").select(F.col("user_id").alias("part"), F.col("event_id").alias("start")))


@C.add(sql(tb.SQL_DOCS, "c AS (SELECT doc, 0 AS priority, 'late' AS source FROM docs WHERE doc % 3 = 0 UNION ALL SELECT doc, 1, 'base' FROM docs)", select="SELECT doc, source FROM c QUALIFY rank() OVER (PARTITION BY doc ORDER BY priority) = 1"))
def choose_text(spark, d):
    """Cascade of sources."""
    x = _docs(spark, d).select(F.col("doc_id").alias("doc"), "text")
    c = x.where("doc % 3 = 0").select("doc", F.lit(0).alias("priority"), F.lit("late").alias("source"), "text").unionByName(x.select("doc", F.lit(1).alias("priority"), F.lit("base").alias("source"), "text"))
    return st.choose_text(c).select("doc", "source")


@C.add(sql(tb.SQL_DOCS, "two AS (SELECT doc, 'first' AS reason, 0 AS p FROM docs WHERE doc % 6 = 0 UNION ALL SELECT doc, 'second', 1 FROM docs WHERE doc % 4 = 0)", select="SELECT doc, reason FROM two QUALIFY row_number() OVER (PARTITION BY doc ORDER BY p) = 1"))
def merge_exclusions(spark, d):
    """J21, J13."""
    x = tb.docs(spark, d).select("doc")
    return st.merge_exclusions(x.where("doc % 6 = 0").withColumn("reason", F.lit("first")), x.where("doc % 4 = 0").withColumn("reason", F.lit("second")))


# Questions



@C.add(sql(tb.SQL_QA, select="SELECT conv_id, turn, q, a FROM qa"))
def qa_pairs(spark, d):
    """Each user turn with the answer after it."""
    return tb.qa(spark, d)


@C.add(sql(tb.SQL_QA, "k AS (SELECT *, substr(lower(regexp_replace(regexp_extract(q, '^[^。！？!?\\n]*[。！？!?]?'), '[\\s。！？!?，,、；;：:（）()《》〈〉「」『』\\[\\]【】…—\\-]+', '', 'g')), 1, 24) AS key FROM qa)", select="SELECT conv_id, turn FROM k QUALIFY row_number() OVER (PARTITION BY conv_id % 10, key ORDER BY turn, length(a) DESC, q, conv_id) = 1"))
def qa_dedupe(spark, d):
    """One row per question key."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.col("conv_id") % 10, tx.question_key(F.col("q"))).orderBy("turn", F.desc(F.length("a")), "q", "conv_id")
    return tb.qa(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("conv_id", "turn")


@C.add(sql(tb.SQL_BLOCKS, "r AS (SELECT doc, ord AS s, ord + 2 AS e FROM blocks WHERE ord % 5 = 0)", select="SELECT doc, ord FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = b.doc AND b.ord >= s AND b.ord < e)"))
def uncovered_blocks(spark, d):
    """J12."""
    b = tb.blocks(spark, d)
    return qa_ops.uncovered(b, b.where("ord % 5 = 0").select("doc", F.col("ord").alias("start"), (F.col("ord") + 2).alias("end"))).select("doc", "ord")


@C.add(sql(tb.SQL_BLOCKS, "x AS (SELECT doc, ord, text, concat_ws(chr(10), text, lead(text) OVER w, lead(text, 2) OVER w) AS near FROM blocks WINDOW w AS (PARTITION BY doc ORDER BY ord))", "p AS (SELECT doc, substr(text, 1, 30) AS q, lead(text) OVER (PARTITION BY doc ORDER BY ord) AS a FROM blocks)", "u AS (SELECT DISTINCT doc, q, a FROM p WHERE a IS NOT NULL)", select="SELECT u.doc, q, a, min(ord) AS ord FROM u LEFT JOIN x ON x.doc = u.doc AND contains(text, q) AND contains(near, substr(a, 1, 24)) GROUP BY ALL"))
def locate_qa(spark, d):
    """Question in a block, head of the answer near it."""
    from pyspark.sql import Window

    b = tb.blocks(spark, d)
    q = b.select("doc", F.substring("text", 1, 30).alias("q"), F.lead("text").over(Window.partitionBy("doc").orderBy("ord")).alias("a")).where("a is not null").distinct()
    return qa_ops.locate_qa(q, b)


@C.add(sql(tb.SQL_SPOKEN, select="SELECT doc, trim(speaker, ' ') AS speaker, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(text, '(?m)^[ \\t]*([^：:\\n]{1,20})[：:]', 1)) AS speaker FROM spoken) WHERE trim(speaker, ' ') <> '' GROUP BY ALL HAVING count(*) >= 2"))
def speaker_counts(spark, d):
    """Names that open lines of a conversation."""
    return qa_ops.speaker_counts(tb.spoken_blocks(spark, d))


ANSWERS = """cut AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), own AS (SELECT doc_id, regexp_replace(trim(regexp_replace(t, '^(?:[AＡaａ]\\s*[：:]|(?:答|回答)\\s*[：:])[ \\t]*', ''), ' '), '(?:\\s*\\n?[ \\t]*[-—－━=]{4,}[ \\t]*)+$', '') AS t FROM cut),
    ln AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM own), at1 AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)the')), true), 0) AS p FROM ln),
    win AS (SELECT *, array_to_string(CASE WHEN p > 0 THEN l[greatest(1, p - 2):least(len(l), p + 2)] ELSE l[1:4] END, chr(10)) AS w, p > 3 AS b, CASE WHEN p > 0 THEN p + 2 < len(l) ELSE len(l) > 4 END AS a FROM at1)"""


@C.add(sql(ANSWERS, select="SELECT doc_id, CASE WHEN b THEN '…' ELSE '' END || substr(w, 1, 420) || CASE WHEN a OR length(w) > 420 THEN '…' ELSE '' END AS excerpt, b OR a OR length(w) > 420 AS truncated FROM win"))
def answer_excerpts(spark, d):
    """M09, F21."""
    e = sn.answer_excerpt(tx.clean_answer(F.col("text")), F.lit("(?i)the"))
    return _docs(spark, d).select("doc_id", e["excerpt"].alias("excerpt"), e["truncated"].alias("truncated"))


@C.add(sql(tb.SQL_QA, """a AS (SELECT conv_id % 5 AS query_id, conv_id AS doc, turn AS start, q AS text FROM qa), v AS (SELECT query_id, 'qa' AS kind, 0 AS k, doc, start, text FROM a WHERE doc % 2 = 0 UNION ALL SELECT query_id, 'pointer', 1, doc, start, text FROM a WHERE doc % 3 = 0
    UNION ALL SELECT query_id, 'supplement', 2, doc, start, text FROM a s WHERE doc % 2 = 1 AND NOT EXISTS (SELECT 1 FROM a o WHERE o.doc % 2 = 0 AND o.query_id = s.query_id AND lower(regexp_replace(o.text, '[\\s。！？!?，,、；;：:（）()《》〈〉「」『』\\[\\]【】…—\\-]+', '', 'g')) = lower(regexp_replace(s.text, '[\\s。！？!?，,、；;：:（）()《》〈〉「」『』\\[\\]【】…—\\-]+', '', 'g'))))""", select="SELECT query_id, kind, doc, start, text, row_number() OVER (PARTITION BY query_id ORDER BY k, doc, start, text) AS place, count(*) OVER (PARTITION BY query_id, kind) AS of_kind FROM v"))
def official_view(spark, d):
    """Three kinds in one view."""
    x = tb.qa(spark, d).select((F.col("conv_id") % 5).alias("query_id"), F.col("conv_id").alias("doc"), F.col("turn").alias("start"), F.col("q").alias("text"))
    return qa_ops.official_view(x.where("doc % 2 = 0"), x.where("doc % 3 = 0"), x.where("doc % 2 = 1"))


# Duplicates and checks


@C.add(sql(select="SELECT doc_id AS doc, first AS canonical, copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first, count(*) OVER (PARTITION BY k) AS copies FROM (SELECT doc_id, regexp_replace(text, '[\\s　]+', '', 'g') AS k FROM documents) WHERE k <> '') WHERE doc_id <> first"))
def exact_duplicates(spark, d):
    """A20."""
    return dedupe.exact_duplicates(tb.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


@C.add(sql(tb.SQL_BLOCKS, "o AS (SELECT doc, ord, len, sum(len + 1) OVER (ORDER BY doc, ord) - (len + 1) + CASE WHEN doc % 100 = 0 THEN 1 ELSE 0 END AS s, sum(len + 1) OVER (ORDER BY doc, ord) - (len + 1) AS t FROM blocks)", select="SELECT doc, ord, CAST(t AS BIGINT) AS start, len, CAST(s AS BIGINT) AS start_b, len AS len_b FROM o WHERE s <> t"))
def quality_offsets(spark, d):
    """Q01: offsets that disagree."""
    b = bl.with_offsets(tb.blocks(spark, d)).select("doc", "ord", "start", "len")
    return quality.blocks_against_offsets(b, b.withColumn("start", F.col("start") + F.when(F.col("doc") % 100 == 0, 1).otherwise(0)))


@C.add(sql(tb.SQL_PAGE_LINES, select="SELECT doc, ord FROM page_lines WHERE text <> '' AND regexp_matches(text, '(?i)<a\\b|<br\\b|https?://|www\\.|\\]\\(http')"))
def quality_markup(spark, d):
    """Q02: source lines of pages with links or breaks."""
    return quality.left_markup(tb.page_lines(spark, d))


@C.add(sql(tb.SQL_BLOCKS, select="SELECT doc, ord FROM blocks WHERE doc % 50 = 0"))
def quality_excluded(spark, d):
    """Q04."""
    return quality.excluded_but_there(tb.blocks(spark, d), tb.docs(spark, d).where("doc % 50 = 0").select("doc"))


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_CHAPTERS, INTERVALS, select="SELECT b.doc, ord FROM blocks b LEFT JOIN loc l ON b.doc = l.doc AND ord >= start AND (stop IS NULL OR ord < stop) WHERE path IS NULL OR path = ''"))
def quality_locations(spark, d):
    """Q05."""
    return quality.without_location(locate_blocks(spark, d))


@C.add(sql(select="SELECT o_orderkey AS doc, o_custkey AS key, o_orderkey % 4 AS section FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) OR o_orderkey % 4 >= 3 OR o_custkey <> o_orderkey"))
def quality_jumps(spark, d):
    """Q06: jumps without a target."""
    j = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 4).alias("section"))
    c = tb.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("doc"), F.lit(3).alias("sections"))
    return quality.broken_jumps(j, c)


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_CHAPTERS, select="SELECT doc % 20 AS doc, start, CAST(NULL AS BIGINT) AS \"end\", count(*) AS n FROM chapters GROUP BY ALL HAVING count(*) > 1"))
def quality_footprints(spark, d):
    """Q09: chapters that share a range."""
    c = tb.chapters(spark, d).select((F.col("doc") % 20).alias("doc"), "start", F.lit(None).cast("long").alias("end"))
    return quality.repeated_footprints(c)


@C.add(sql(tb.SQL_BLOCKS, select="SELECT CAST(sum(len + 1) - 1 AS BIGINT) AS length FROM blocks HAVING sum(len + 1) - 1 <> 1000"))
def quality_baseline(spark, d):
    """Q10."""
    return quality.baseline_differs(tb.blocks(spark, d), 1000)


@C.add(sql(tb.SQL_BLOCKS, select="SELECT doc, ord, CAST(2 AS BIGINT) AS n FROM blocks WHERE ord % 6 = 0"))
def quality_partition(spark, d):
    """Blocks in both parts."""
    b = tb.blocks(spark, d)
    return quality.duplicated_partition(b.where("ord % 2 = 0"), b.where("ord % 3 = 0"))


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_DOCS, select="SELECT (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM blocks) AS blocks, (SELECT CAST(sum(len) AS BIGINT) FROM blocks) AS chars, (SELECT count(DISTINCT work) FROM docs) AS works"))
def status(spark, d):
    """Build statistics."""
    b = tb.blocks(spark, d).agg(F.count("*").alias("blocks"), F.sum("len").alias("chars"))
    x = tb.docs(spark, d).agg(F.count("*").alias("docs"), F.countDistinct("work").alias("works"))
    return b.crossJoin(x).select("docs", "blocks", "chars", "works")


# Rules that no other query names, over whole tables


@C.add(sql(tb.SQL_LONG_WORDS, "t AS (SELECT doc_id, unnest(ws) AS t FROM long_words)", select="SELECT doc_id, string_agg('(?:(?<![A-Za-z0-9])' || t || '(?![A-Za-z0-9]))', '|' ORDER BY length(t) DESC, t) AS pattern FROM (SELECT DISTINCT doc_id, t FROM t) GROUP BY doc_id"))
def variant_patterns(spark, d):
    """One alternation of every document's long words, longest first, whatever their case and repeats."""
    w = tb.long_words(spark, d).where("size(ws) > 0")
    spread = F.flatten(F.array("ws", F.transform("ws", lambda x: F.concat(F.lit(" "), F.upper(x)))))
    return w.select("doc_id", tx.terms_pattern(spread).alias("pattern"))


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_HEADED, select="SELECT doc, ord, text = c OR (starts_with(text, c) AND regexp_matches(substr(text, length(c) + 1, 1), '[\\s(\\[]')) AS heads FROM (SELECT doc, ord, trim(text) AS text, CASE WHEN ord % 2 = 0 THEN 'Act' ELSE trim(substr(text, 1, 5)) END AS c FROM headed)"))
def chapter_headings(spark, d):
    """Lines that are a chapter's name, or that and a space or bracket."""
    h = tb.headed_blocks(spark, d)
    return h.select("doc", "ord", tx.is_chapter_heading(F.col("text"), F.when(F.col("ord") % 2 == 0, "Act").otherwise(F.trim(F.substring("text", 1, 5)))).alias("heads"))


@C.add(sql(select="SELECT event_id, array_to_string(list_filter(list_transform(regexp_extract_all(props, '\"([^\"\n]+)\"', 1), lambda x: trim(replace(x, '_', ''))), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)\\.(png|jpg|jpeg|bmp|wav|ogg|mp3|cur|txt)$')), chr(10)) AS spoken FROM events WHERE props IS NOT NULL"))
def quoted_strings(spark, d):
    """The quoted strings of scripts, here of the properties of all events."""
    return tb.table(spark, d, "events").where("props is not null").select("event_id", tx.script_dialogue(F.col("props")).alias("spoken"))


ENOUGH = lambda c: f"length(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}#*$%&|<>@^_`~+={{}}\\\\]', '', 'g')) >= 2"


@C.add(sql("q AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)", f"r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' A ' WHEN turn % 3 = 1 THEN substr(text, 1, 3) ELSE text END AS q, substr(next, 1, 4) AS a FROM q WHERE next IS NOT NULL)", select=f"SELECT conv_id, turn, trim(q) <> 'A' AND {ENOUGH('q')} AND {ENOUGH('a')} AS valid FROM r"))
def valid_questions(spark, d):
    """P20: which turns and beginnings of the next ones make a question and an answer."""
    from pyspark.sql import Window

    c = tb.table(spark, d, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    q = F.when(F.col("turn") % 3 == 0, " A ").when(F.col("turn") % 3 == 1, F.substring("text", 1, 3)).otherwise(F.col("text"))
    return c.select("conv_id", "turn", tx.valid_qa(q, F.substring("next", 1, 4)).alias("valid"))


@C.add(sql(r"""t AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<a\b[^>]*>(.*?)</a>', '\1', 'g'), '(?i)\[([^\]]{0,200})\]\((?:(?:https?://|www\.)[^)]+)\)', '\1', 'g'), '(?i)(?:https?://|www\.)[^\s<>"“”]+', '', 'g'), chr(10)) AS ls FROM pages)""".replace("\\\\", "\\"),
           select=r"SELECT page_id, array_to_string(list_transform(list_filter(ls, lambda x: regexp_replace(x, '^[ \t;；,，、:：\-—–·]+|[ \t;；,，、:：\-—–·]+$', '', 'g') NOT IN ('', '官网', '来源', '原文', '网址', '链接', '离线版', '其他版本')), lambda x: trim(x, ' ')), chr(10)) AS text FROM t"))
def stripped_links(spark, d):
    """whole pages without links of any kind and without lines that only name one."""
    return tb.table(spark, d, "pages").select("page_id", tx.strip_links(F.col("html")).alias("text"))


@C.add(sql(select="SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10)) AS text FROM documents"))
def newline_forms(spark, d):
    """texts of other systems come back with line feeds alone and no blanks at line ends."""
    foreign = F.concat(F.lit("\ufeff"), F.regexp_replace("text", "\n", " \t\r\n"))
    return tb.table(spark, d, "documents").select("doc_id", tx.normalize_newlines(foreign).alias("text"))


@C.add(sql(tb.SQL_LONG_WORDS, "t AS (SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS t, unnest(range(len(ws))) AS i FROM long_words) WHERE length(t) <= 80 GROUP BY doc_id, t)", "n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM t)", select="SELECT doc_id, string_agg(t, '|' ORDER BY n) AS terms FROM n WHERE n <= 32 GROUP BY doc_id"))
def term_lists(spark, d):
    """lists of terms given as JSON: trimmed, each once, the first thirty-two."""
    w = tb.long_words(spark, d).where("size(ws) > 0")
    raw = F.to_json(F.flatten(F.transform("ws", lambda x: F.array(F.concat(F.lit(" "), x, F.lit(" ")), F.upper(x), F.lit(" ")))))
    return w.select("doc_id", F.array_join(tx.parse_terms(raw), "|").alias("terms"))


@C.add(sql(select="SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE doc_id END AS number FROM documents"))
def path_numbers(spark, d):
    """the number in front of a part of a path."""
    path = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", F.lit("x_1"), "source", F.concat("doc_id", F.lit("_"), "lang"))).when(F.col("doc_id") % 3 == 1, F.concat("doc_id", F.lit("_x/9_y"))).otherwise(F.concat(F.lit("x"), "doc_id", F.lit("_y")))
    return tb.table(spark, d, "documents").select("doc_id", tx.int_prefix(path).cast("long").alias("number"))


@C.add(sql(tb.SQL_LONG_WORDS, tb.SQL_WORD_ALIASES, "late AS (SELECT DISTINCT ws[2] AS nick, first(ws[3] ORDER BY doc_id) OVER (PARTITION BY ws[2]) AS target FROM long_words WHERE len(ws) >= 3)", select="SELECT nick, array_to_string(targets, '|') AS targets, 1 AS priority FROM aliases UNION ALL SELECT nick, target, 2 FROM late WHERE nick <> target AND nick NOT IN (SELECT nick FROM aliases)"))
def loaded_aliases(spark, d):
    """Alias maps of two sources as JSON, lists and single targets; the first that names a nick wins."""
    from corpusq.operators import aliases as al

    listed = tb.word_aliases(spark, d).select(F.lit(1).alias("source"), F.to_json(F.create_map("nick", F.array_append("targets", F.col("nick")))).alias("json"))
    w = tb.long_words(spark, d).where("size(ws) >= 3").groupBy(F.get("ws", F.lit(1)).alias("nick")).agg(F.min_by(F.get("ws", F.lit(2)), "doc_id").alias("target"))
    single = w.select(F.lit(2).alias("source"), F.to_json(F.create_map("nick", "target")).alias("json"))
    return al.load_aliases(listed.unionByName(single)).withColumn("targets", F.array_join("targets", "|"))


@C.add(sql(tb.SQL_BLOCKS, select="SELECT doc, ord, text, len, CAST(sum(len + 1) OVER (ORDER BY doc, ord) - (len + 1) AS BIGINT) AS start FROM blocks WHERE trim(text, ' ') <> ''"))
def published_version(spark, d):
    """All blocks with offsets, published with a manifest and read back; a later version that fails its check leaves no trace."""
    from corpusq.operators.blocks import with_offsets
    from corpusq.sources import publish
    from corpusq.sources.storage import new_folder

    folder, b = new_folder(spark, "published"), tb.blocks(spark, d)
    rows = with_offsets(b.where("trim(text) <> ''").withColumn("len", F.length("text"))).select("doc", "ord", "text", "len", "start")
    publish.publish_version(spark, {"blocks": rows, "docs": tb.docs(spark, d)}, folder, {"lengths": lambda t: t["blocks"].where("len <> length(text)")})
    try:
        publish.publish_version(spark, {"blocks": rows.limit(1)}, folder, {"never": lambda t: t["blocks"]})
    except ValueError:
        pass
    return publish.read_version(spark, folder)["blocks"]


@C.add(sql(tb.SQL_QA, select="SELECT conv_id, turn, q, a, true AS current FROM qa"))
def published_qa_index(spark, d):
    """The question index as published, and whether it still equals a new one."""
    from corpusq.sources import publish
    from corpusq.sources.storage import new_folder

    path, rows = new_folder(spark, "qa"), tb.qa(spark, d).select("conv_id", "turn", "q", "a")
    publish.publish_qa_index(rows, path)
    return spark.read.parquet(path).withColumn("current", F.lit(publish.qa_index_is_current(spark, path, rows) and not publish.qa_index_is_current(spark, path, rows.where("turn > 0"))))
