"""Queries that put several operators together: searches, trees, builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.functions import lang as lg
from corpusq.operators import aliases as al
from corpusq.operators import build, glossary, multiterm, quality, reading, story, suggest
from corpusq.operators import scope as sc
from corpusq.operators import search as se
from corpusq.plans import search
from corpusq.plans import tables as tb
from corpusq.plans.registry import Catalog
from corpusq.plans.tables import sql

C = Catalog()

# What the aliases make of the queries of tables.ASKED: canonical form, and the words that are searched for.
CANONICAL = [(1, "attion"), (4, "der"), (5, "nothing"), (6, "the")]
AMBIGUOUS = [(2, 0, "license"), (2, 1, "licence"), (3, 0, "license"), (3, 1, "licence")]
VARIANTS = [(1, "att"), (1, "attion"), (2, "lic"), (2, "license"), (2, "licence"), (3, "license"), (3, "licence"), (4, "der"), (4, "die"), (5, "nothing"), (6, "the"), (6, "article")]
EVERY = CANONICAL + [(2, "lic"), (3, "license")]


def _entries(spark, d):
    return tb.entries(spark, d).select("entry_id", "doc", "group_id", "term", "body", F.lit(0).alias("family"), F.lit(0).alias("freq"))


def _no_rewrites(spark):
    return spark.createDataFrame([], "phrase string, ord int, targets array<string>")


def _variants(spark, d):
    none = tb.entries(spark, d).select("term", F.lit(None).cast("string").alias("concept_id"))
    return al.expand_terms(tb.asked(spark), tb.aliases(spark), none, _no_rewrites(spark))


@C.add(sql(*search.ASKED, search.BEST, "rewrites AS (SELECT '' AS phrase, 0 AS ord, '' AS target WHERE false), concepts AS (SELECT '' AS term, '' AS concept_id WHERE false)", search.VARIANTS, select="SELECT query_id, lower(term) AS term FROM variants"))
def query_variants(spark, d):
    """The words under which a query of every document is searched, by its aliases alone."""
    none = tb.entries(spark, d).select("term", F.lit(None).cast("string").alias("concept_id"))
    return al.expand_terms(tb.word_queries(spark, d), tb.word_aliases(spark, d), none, _no_rewrites(spark)).select("query_id", F.lower("term").alias("term"))


@C.add(sql(*search.ALL_VARIANTS, select="SELECT canon.query_id, canon.q AS requested, c AS canonical, CASE WHEN c <> canon.q THEN nick || '→' || c ELSE '' END AS notes, (SELECT string_agg(term, '|' ORDER BY ord) FROM variants v WHERE v.query_id = canon.query_id) AS variants FROM canon LEFT JOIN best USING (query_id)"))
def resolved_queries(spark, d):
    """Requested and canonical form with notes and variants of a query of every document."""
    r = al.resolve(tb.word_queries(spark, d), tb.word_aliases(spark, d), tb.word_concepts(spark, d), tb.word_rewrites(spark, d))
    return r.select("query_id", "requested", "canonical", F.array_join("notes", "|").alias("notes"), F.array_join("variants", "|").alias("variants"))


GROUPED = """asked_parts AS (SELECT doc_id AS query_id, [ws[1], upper(ws[2]), ws[1], ws[4]] AS parts FROM long_words WHERE len(ws) >= 4),
    asked AS (SELECT query_id * 10 + i AS query_id, parts[i] AS q FROM (SELECT query_id, parts, unnest(range(1, 5)) AS i FROM asked_parts))"""
GROUPS = """named AS (SELECT a.query_id // 10 AS query_id, a.query_id % 10 AS place, a.q AS term, CASE WHEN len(targets) = 1 THEN targets[1] ELSE a.q END AS canonical FROM asked a LEFT JOIN best USING (query_id)),
    once AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY query_id, lower(canonical) ORDER BY place) = 1)"""


@C.add(sql(tb.SQL_LONG_WORDS, tb.SQL_WORD_ALIASES, GROUPED, search.BEST, GROUPS, select='SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS "group", term, canonical FROM once QUALIFY count(*) OVER (PARTITION BY query_id) >= 2'))
def term_groups(spark, d):
    """Groups of a multi-term query of every document, equal ones once."""
    w = lambda i: F.get("ws", F.lit(i))
    q = tb.long_words(spark, d).where("size(ws) >= 4").select(F.col("doc_id").alias("query_id"), F.concat(w(0), F.lit(", "), F.upper(w(1)), F.lit("; "), w(0), F.lit("｜"), w(3)).alias("q"))
    return al.term_groups(q, tb.word_aliases(spark, d))


DEFINED = f"""canon AS (SELECT query_id, 0 AS target, q FROM {tb.values(CANONICAL)} v(query_id, q) UNION ALL SELECT * FROM {tb.values(AMBIGUOUS)} v(query_id, target, q)),
    m AS (SELECT query_id, target, q, entry_id, group_id, term, body, CASE WHEN term = q THEN 0 WHEN starts_with(term, q) AND query_id NOT IN (2, 3) THEN 1 WHEN query_id NOT IN (2, 3) AND regexp_matches(lower(body), '(^|[^a-z0-9])' || q || '([^a-z0-9]|$)') THEN 2 END AS bucket FROM canon, entries),
    keyed AS (SELECT *, CASE bucket WHEN 0 THEN (length(regexp_replace(body, '\\s+', '', 'g')) < 40)::INT WHEN 1 THEN 0 ELSE -len(regexp_extract_all(lower(body), q)) END AS k1, CASE bucket WHEN 0 THEN -length(body) WHEN 1 THEN 0 ELSE length(body) END AS k2 FROM m WHERE bucket IS NOT NULL),
    best AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY query_id, target, group_id ORDER BY bucket, k1, k2, length(term), entry_id) = 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY bucket, k1, k2, length(term), entry_id) AS p FROM best),
    once AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY query_id, group_id ORDER BY target, p) = 1),
    defined AS (SELECT query_id, entry_id, CASE bucket WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' ELSE 'body' END AS match, row_number() OVER (PARTITION BY query_id ORDER BY target, p) AS place FROM once)"""


@C.add(sql(tb.SQL_ENTRIES, DEFINED, select="SELECT query_id, entry_id, match, place FROM defined"))
def definitions(spark, d):
    """Ranked definitions; an ambiguous alias gives the exact cards of all targets."""
    return se.definitions(tb.asked(spark), tb.aliases(spark), _entries(spark, d)).select("query_id", "entry_id", "match", "place")


FOUND = f"""asked AS (SELECT query_id, q FROM {tb.values(EVERY)} v(query_id, q)), var AS (SELECT query_id, term FROM {tb.values(VARIANTS)} v(query_id, term)),
    hits AS (SELECT query_id, doc, ord, count(*) AS n FROM tokens JOIN var ON t = term GROUP BY ALL),
    cards AS (SELECT query_id, entry_id, match, row_number() OVER (PARTITION BY query_id ORDER BY place) AS card FROM (SELECT *, row_number() OVER (PARTITION BY query_id, match ORDER BY place) AS i FROM defined) WHERE match = 'exact' OR i <= CASE match WHEN 'contains' THEN 10 ELSE 6 END QUALIFY card <= 26),
    placed2 AS (SELECT query_id, doc, ord, n, work, row_number() OVER (PARTITION BY query_id, work ORDER BY kr, CASE WHEN r > 1 THEN 1 ELSE 0 END, doc, ord) AS place FROM (SELECT h.*, work, CASE kind WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 4 END AS kr, row_number() OVER (PARTITION BY query_id, work, CASE kind WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 4 END, doc ORDER BY ord) AS r FROM hits h JOIN docs USING (doc))),
    picked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, work) AS pick FROM placed2 WHERE place <= 8 QUALIFY pick <= 60),
    word AS (SELECT query_id, '(^|[^a-z0-9])' || q || '([^a-z0-9]|$)' AS p, q FROM asked)"""
SECTIONS = """SELECT query_id, 'definition' AS section, card AS place, entry_id AS doc, CAST(NULL AS BIGINT) AS ord, match AS label, CAST(NULL AS BIGINT) AS n FROM cards WHERE card <= 26
    UNION ALL SELECT query_id, 'interview', row_number() OVER (PARTITION BY query_id ORDER BY b.doc, b.ord) AS place, b.doc, b.ord, NULL, NULL FROM blocks b JOIN docs USING (doc), word WHERE work = 'src2' AND regexp_matches(lower(text), p) QUALIFY place <= 8
    UNION ALL SELECT query_id, 'qa', row_number() OVER (PARTITION BY query_id ORDER BY conv_id, turn) AS place, conv_id, turn, NULL, NULL FROM qa, word WHERE regexp_matches(lower(qa.q), p) QUALIFY place <= 8
    UNION ALL SELECT query_id, 'related', place, NULL, NULL, other, n FROM rel JOIN asked ON rel.term = q
    UNION ALL SELECT query_id, 'classification', row_number() OVER (PARTITION BY query_id ORDER BY leaf), NULL, NULL, leaf, NULL FROM (SELECT DISTINCT query_id, leaf FROM entries JOIN asked ON term = q)
    UNION ALL SELECT query_id, 'work', row_number() OVER (PARTITION BY query_id ORDER BY work), count(DISTINCT doc), count(*), work, CAST(sum(n) AS BIGINT) FROM hits JOIN docs USING (doc) GROUP BY query_id, work
    UNION ALL SELECT query_id, 'passage', pick, doc, ord, work, n FROM picked
    UNION ALL SELECT query_id, 'mode', 1, NULL, NULL, CASE WHEN query_id NOT IN (SELECT query_id FROM hits) AND query_id IN (SELECT query_id FROM cards) THEN 'subphrase' ELSE 'exact' END, NULL FROM asked"""
REL = f"""heldw AS (SELECT DISTINCT doc, ord, t FROM tokens JOIN {tb.values(search.RELATED)} v(i, w) ON t = w), rel AS (SELECT a.t AS term, b.t AS other, count(*) AS n, row_number() OVER (PARTITION BY a.t ORDER BY count(*) DESC, b.t) AS place FROM heldw a JOIN heldw b USING (doc, ord) WHERE a.t <> b.t GROUP BY 1, 2 QUALIFY place <= 12)"""


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_TOKENS, tb.SQL_DOCS, tb.SQL_ENTRIES, tb.SQL_QA, DEFINED, FOUND, REL, select=SECTIONS))
def search_batch(spark, d):
    """All sections of a table of queries."""
    blocks, docs = tb.blocks(spark, d), tb.docs(spark, d)
    ranked = docs.withColumns({"kind_rank": F.when(F.col("kind") == "en", 0).when(F.col("kind") == "de", 1).otherwise(4), "work_rank": F.lit(0)})
    interviews = blocks.join(docs.where("work = 'src2'").select("doc"), "doc", "left_semi")
    qa = tb.qa(spark, d).select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("ord"), "q")
    related = suggest.related_terms(blocks, tb.terms(spark, search.RELATED))
    return se.search(tb.asked(spark), tb.aliases(spark), _variants(spark, d).select("query_id", "term"), _entries(spark, d), interviews, qa, blocks, ranked, related, glossary.term_leaves(tb.entries(spark, d)))


TEXTS = """texts AS (SELECT 'definition' AS kind, doc, entry_id AS item, term || chr(10) || body AS text FROM entries UNION ALL SELECT 'qa', conv_id, conv_id * 1000 + turn, q || chr(10) || a FROM qa),
    blocks AS (SELECT kind || '|' || doc AS doc, item AS ord, text FROM texts)"""
MULTI = """held AS (SELECT u.*, s.span, split_part(u.doc, '|', 1) AS kind, CAST(split_part(u.doc, '|', 2) AS BIGINT) AS d FROM units u JOIN spans s USING (query_id, doc, ord) JOIN lv USING (query_id) WHERE bit_count(u.mask) = level),
    cards AS (SELECT h.*, group_id, length(regexp_replace(body, '\\s+', '', 'g')) < 40 AS r1, -definition_quality AS r2, -length(body) AS r3 FROM held h JOIN entries ON h.ord = entry_id WHERE kind = 'definition'),
    one AS (SELECT *, bit_or(mask) OVER (PARTITION BY query_id, group_id) AS all_mask FROM cards QUALIFY row_number() OVER (PARTITION BY query_id, group_id ORDER BY span, r1, r2, r3, ord) = 1),
    listed AS (SELECT query_id, kind, row_number() OVER (PARTITION BY query_id ORDER BY span, r1, r2, r3, ord) AS place, d AS doc, ord AS item, span, all_mask AS m FROM one QUALIFY place <= 26
        UNION ALL SELECT query_id, kind, row_number() OVER (PARTITION BY query_id ORDER BY span, d, ord) AS place, d, ord, span, mask FROM held WHERE kind = 'qa' QUALIFY place <= 8)"""


@C.add(sql(tb.SQL_ENTRIES, tb.SQL_QA, TEXTS, tb.SQL_TOKENS, tb.SQL_GROUPS, search.UNITS, search.span_sql("blocks"), MULTI, select="SELECT l.query_id, kind, place, doc, item, span, array_to_string((SELECT list(term ORDER BY g) FROM grp WHERE grp.query_id = l.query_id AND (m >> g::INT) & 1 = 1), '|') AS terms, CAST(level AS BIGINT) AS level, level < (SELECT count(DISTINCT g) FROM grp WHERE grp.query_id = l.query_id) AS relaxed FROM listed l JOIN lv USING (query_id)"))
def search_multi(spark, d):
    """Definitions and questions that hold the groups of multi-term queries."""
    e = tb.entries(spark, d)
    q = tb.qa(spark, d).withColumn("item", F.col("conv_id") * 1000 + F.col("turn"))
    texts = e.select(F.lit("definition").alias("kind"), "doc", F.col("entry_id").alias("item"), F.concat_ws("\n", "term", "body").alias("text"))
    texts = texts.unionByName(q.select(F.lit("qa").alias("kind"), F.col("conv_id").alias("doc"), F.col("item").cast("long").alias("item"), F.concat_ws("\n", "q", "a").alias("text")))
    ranks = e.select(F.col("entry_id").alias("item"), "group_id", glossary.entry_rank(F.col("body"), F.col("definition_quality")).alias("rank"))
    return multiterm.search_multi(tb.groups(spark), texts, ranks).withColumn("terms", F.array_join("terms", "|"))


@C.add(sql(*search.U, tb.SQL_DOCS, select="SELECT query_id, work, doc, ord, rank, total, total > 15 AS has_more FROM (SELECT query_id, work, doc, ord, row_number() OVER (PARTITION BY query_id ORDER BY work, doc, ord) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM units JOIN lv USING (query_id) JOIN docs USING (doc) WHERE bit_count(mask) = level) WHERE rank > 5 AND rank <= 15"))
def multi_term_listing(spark, d):
    """A page of multi-term passages."""
    return se.list_units(search._units(spark, d), tb.docs(spark, d), 5, 10).select("query_id", "work", "doc", "ord", "rank", "total", "has_more")


# Scopes of the queries: none, a work, a top scope, a work and language, all, an unknown key.
SCOPES = [(1, "work:src2"), (2, "top:top1"), (3, "sub:src2|en"), (4, "all"), (5, ""), (6, "work:none")]
ALLOW = f"""allow AS (SELECT query_id, doc FROM {tb.values(SCOPES)} v(query_id, scope), (SELECT doc_id AS doc, source AS work, lang AS sub, 'top' || (CAST(substr(source, 4) AS INT) % 3)::VARCHAR AS top FROM documents) s
    WHERE scope IN ('', 'all') OR scope IN ('top:' || top, 'work:' || work, 'sub:' || work || '|' || sub))"""
# The same statements over what the scopes allow: entries, hits and units are joined with it.
SCOPED_DEFINED = DEFINED.replace("FROM canon, entries)", "FROM canon JOIN allow USING (query_id) JOIN entries USING (doc))")
SCOPED_FOUND = FOUND.replace("FROM tokens JOIN var ON t = term GROUP BY ALL)", "FROM tokens JOIN var ON t = term JOIN allow USING (query_id, doc) GROUP BY ALL)")
SCOPED_SECTIONS = SECTIONS.replace("FROM blocks b JOIN docs USING (doc), word WHERE", "FROM blocks b JOIN docs USING (doc) JOIN allow USING (doc) JOIN word USING (query_id) WHERE").replace("FROM qa, word WHERE", "FROM qa JOIN allow ON allow.doc = conv_id JOIN word USING (query_id) WHERE")
SCOPED_UNITS = search.UNITS.replace("FROM toks GROUP BY ALL)", "FROM toks JOIN allow USING (query_id, doc) GROUP BY ALL)")


def _scoped(spark, d):
    bitmaps = sc.scope_bitmaps(sc.scopes(search._scope_docs(spark, d), search._taxonomy(spark, d)))
    return tb.asked(spark).join(spark.createDataFrame(SCOPES, "query_id long, scope string"), "query_id"), bitmaps


@C.add(sql(tb.SQL_ENTRIES, ALLOW, SCOPED_DEFINED, select="SELECT query_id, entry_id, match, place FROM defined"))
def scoped_definitions(spark, d):
    """Ranked definitions in the scope of each query."""
    asked, bitmaps = _scoped(spark, d)
    return se.definitions(asked, tb.aliases(spark), _entries(spark, d), scopes=bitmaps).select("query_id", "entry_id", "match", "place")


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_TOKENS, tb.SQL_DOCS, tb.SQL_ENTRIES, tb.SQL_QA, ALLOW, SCOPED_DEFINED, SCOPED_FOUND, REL, select=SCOPED_SECTIONS))
def scoped_search(spark, d):
    """All sections of a table of queries, each in its scope; conversations count as documents of their number."""
    asked, bitmaps = _scoped(spark, d)
    blocks, docs = tb.blocks(spark, d), tb.docs(spark, d)
    ranked = docs.withColumns({"kind_rank": F.when(F.col("kind") == "en", 0).when(F.col("kind") == "de", 1).otherwise(4), "work_rank": F.lit(0)})
    interviews = blocks.join(docs.where("work = 'src2'").select("doc"), "doc", "left_semi")
    qa = tb.qa(spark, d).select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("ord"), "q")
    related = suggest.related_terms(blocks, tb.terms(spark, search.RELATED))
    return se.search(asked, tb.aliases(spark), _variants(spark, d).select("query_id", "term"), _entries(spark, d), interviews, qa, blocks, ranked, related, glossary.term_leaves(tb.entries(spark, d)), scopes=bitmaps)


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_TOKENS, tb.SQL_GROUPS, ALLOW, SCOPED_UNITS, tb.SQL_DOCS, select="SELECT query_id, work, doc, ord, rank, total, total > 15 AS has_more FROM (SELECT query_id, work, doc, ord, row_number() OVER (PARTITION BY query_id ORDER BY work, doc, ord) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM units JOIN lv USING (query_id) JOIN docs USING (doc) WHERE bit_count(mask) = level) WHERE rank <= 15"))
def scoped_listing(spark, d):
    """The first page of multi-term passages in the scope of each query, at the level that the scope reaches."""
    asked, bitmaps = _scoped(spark, d)
    return se.list_units(search._units(spark, d), tb.docs(spark, d), 0, 15, asked=asked, scopes=bitmaps).select("query_id", "work", "doc", "ord", "rank", "total", "has_more")


ALL_TEXTS = """spread AS (SELECT doc_id AS doc, source AS work, unnest(range(len(p))) AS ord, unnest(p) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents)),
    every AS (SELECT kind, doc, item, text FROM texts UNION ALL SELECT 'block', doc, ord, text FROM spread WHERE text <> '' UNION ALL SELECT 'interview', doc, ord, text FROM spread WHERE text <> '' AND work = 'src2'),
    blocks AS (SELECT kind || '|' || doc AS doc, item AS ord, text FROM every)"""
UNITS_OF_KINDS = search.UNITS.replace("FROM toks GROUP BY ALL)", "FROM toks SEMI JOIN allow ON allow.query_id = toks.query_id AND allow.doc = CAST(split_part(toks.doc, '|', 2) AS BIGINT) GROUP BY ALL)")


@C.add(sql(tb.SQL_ENTRIES, tb.SQL_QA, TEXTS.rsplit(",\n", 1)[0], ALL_TEXTS, tb.SQL_TOKENS, tb.SQL_GROUPS, ALLOW, UNITS_OF_KINDS, search.span_sql("blocks"), MULTI.replace("WHERE kind = 'qa' QUALIFY", "WHERE kind IN ('qa', 'interview') QUALIFY").replace("PARTITION BY query_id ORDER BY span, d, ord", "PARTITION BY query_id, kind ORDER BY span, d, ord"),
           select="SELECT l.query_id, kind, place, doc, item, span, array_to_string((SELECT list(term ORDER BY g) FROM grp WHERE grp.query_id = l.query_id AND (m >> g::INT) & 1 = 1), '|') AS terms, CAST(level AS BIGINT) AS level, level < (SELECT count(DISTINCT g) FROM grp WHERE grp.query_id = l.query_id) AS relaxed FROM listed l JOIN lv USING (query_id)"))
def scoped_multi(spark, d):
    """Multi-term search over definitions, interviews, questions and blocks, in the scope of each query."""
    asked, bitmaps = _scoped(spark, d)
    e, blocks = tb.entries(spark, d), tb.blocks(spark, d)
    q = tb.qa(spark, d).withColumn("item", F.col("conv_id") * 1000 + F.col("turn"))
    own = blocks.join(tb.docs(spark, d).where("work = 'src2'").select("doc"), "doc", "left_semi")
    row = lambda t, kind, item, text: t.select(F.lit(kind).alias("kind"), F.col("doc").cast("long").alias("doc"), item.cast("long").alias("item"), text.alias("text"))
    texts = row(e, "definition", F.col("entry_id"), F.concat_ws("\n", "term", "body"))
    for t in (row(q.withColumn("doc", F.col("conv_id")), "qa", F.col("item"), F.concat_ws("\n", "q", "a")), row(blocks, "block", F.col("ord"), F.col("text")), row(own, "interview", F.col("ord"), F.col("text"))):
        texts = texts.unionByName(t)
    ranks = e.select(F.col("entry_id").alias("item"), "group_id", glossary.entry_rank(F.col("body"), F.col("definition_quality")).alias("rank"))
    return multiterm.search_multi(tb.groups(spark), texts, ranks, asked=asked, scopes=bitmaps).withColumn("terms", F.array_join("terms", "|"))


@C.add(sql(tb.SQL_LONG_WORDS, "grp AS (SELECT doc_id AS query_id, i // 2 AS g, CASE WHEN i % 3 = 0 THEN upper(ws[i + 1]) ELSE ws[i + 1] END AS term FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM long_words))", "once AS (SELECT * FROM grp QUALIFY row_number() OVER (PARTITION BY query_id, lower(term) ORDER BY g, term) = 1)", select="SELECT query_id, array_to_string(list(term ORDER BY g, term), '|') AS terms FROM once GROUP BY query_id"))
def highlight_terms(spark, d):
    """Variants to be marked, of groups of every document's long words."""
    w = tb.long_words(spark, d).select(F.col("doc_id").alias("query_id"), F.posexplode("ws").alias("i", "w"))
    g = w.select("query_id", F.expr("i div 2").cast("int").alias("group"), F.when(F.col("i") % 3 == 0, F.upper("w")).otherwise(F.col("w")).alias("term"))
    return multiterm.highlight_terms(g).withColumn("terms", F.array_join("terms", "|"))


TREE = """shown AS (SELECT * REPLACE (CASE WHEN grp = route THEN NULL ELSE grp END AS grp) FROM story),
    nodes AS (SELECT 'top:all' AS node, NULL AS parent, 0 AS n UNION ALL SELECT DISTINCT 'work:' || work, 'top:all', 0 FROM shown UNION ALL SELECT 'work:' || work || '||route:' || route, 'work:' || work, sum((NOT official AND grp IS NULL)::INT) FROM shown GROUP BY work, route
        UNION ALL SELECT 'work:' || work || '||route:' || route || '||group:' || grp, 'work:' || work || '||route:' || route, sum((NOT official)::INT) FROM shown WHERE grp IS NOT NULL GROUP BY work, route, grp
        UNION ALL SELECT 'work:' || work || '||route:' || route || '||chapter:' || doc, 'work:' || work || '||route:' || route || coalesce('||group:' || grp, ''), 1 FROM shown WHERE official
        UNION ALL SELECT 'work:' || work || '||route:' || route || '||chapter:' || doc || '||section:' || s, 'work:' || work || '||route:' || route || '||chapter:' || doc, 0 FROM (SELECT *, unnest(CASE WHEN two THEN [0, 1] ELSE [0] END) AS s FROM shown WHERE official))"""
COUNTED = """up AS (SELECT node AS via, node, n FROM nodes UNION ALL SELECT p.parent, u.node, u.n FROM up u JOIN nodes p ON u.via = p.node WHERE p.parent IS NOT NULL), tree AS (SELECT via AS node, CAST(sum(n) AS BIGINT) AS chapters FROM up GROUP BY via)"""


def _taxonomy(spark, d):
    return tb.table(spark, d, "region").select(F.lit("all").alias("top"), F.col("r_name").alias("work"), F.lit(0).alias("top_ord"), F.col("r_regionkey").alias("work_ord"))


def _tree(spark, d):
    return reading.story_tree(reading.nav_nodes(tb.story_chapters(spark, d), _taxonomy(spark, d)))


@C.add("WITH RECURSIVE " + ",\n".join([tb.SQL_CHAPTER_ROWS, TREE, COUNTED]) + " SELECT node, parent, chapters FROM tree JOIN nodes USING (node)")
def story_tree(spark, d):
    """All nodes of the reading tree with their chapters."""
    return _tree(spark, d).select("node", "parent", "chapters")


@C.add("WITH RECURSIVE " + ",\n".join([tb.SQL_CHAPTER_ROWS, TREE, COUNTED]) + " SELECT parent AS node, 'all' AS above, node AS child, chapters FROM tree JOIN nodes USING (node) WHERE parent LIKE 'work:%' AND parent NOT LIKE '%||%'")
def story_node(spark, d):
    """Children of every work."""
    t = _tree(spark, d)
    n = reading.story_node(t, t.where("kind = 'work'").select("node"))
    return n.select("node", F.lit("all").alias("above"), "child", "chapters")


@C.add(sql(tb.SQL_CHAPTER_ROWS, select="SELECT work, route, row_number() OVER (PARTITION BY work ORDER BY official DESC, route_ord, doc) AS place, count(*) OVER (PARTITION BY work) AS total, title, doc FROM story"))
def story_leaf(spark, d):
    """Chapters of a work in reading order."""
    return reading.story_leaf(tb.story_chapters(spark, d)).drop("official")


@C.add(sql(tb.SQL_CHAPTER_ROWS, select="SELECT work, doc::VARCHAR AS chapter, title, row_number() OVER w AS idx, count(*) OVER (PARTITION BY work) AS total, lag(doc) OVER w::VARCHAR AS prev_key, lead(title) OVER w AS next_title FROM story WHERE official WINDOW w AS (PARTITION BY work ORDER BY route_ord, doc)"))
def official_chapter(spark, d):
    """C11: official chapters with their neighbours."""
    return reading.official_chapter(tb.story_chapters(spark, d)).select("work", "chapter", "title", "idx", "total", "prev_key", "next_title")


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_CHAPTERS, "c AS (SELECT doc, start, lead(start) OVER (PARTITION BY doc ORDER BY start) AS stop FROM chapters)", "two AS (SELECT doc, ord, CASE WHEN ord % 2 = 0 THEN 'main' ELSE 'other' END AS lang FROM blocks)", select="SELECT doc || ':' || start AS key, doc, ord, lang FROM c JOIN two USING (doc) WHERE (ord >= start AND (stop IS NULL OR ord < stop)) OR (lang = 'main' AND ord = start)"))
def chapter_blocks(spark, d):
    """Blocks of each chapter in both languages."""
    c = story.close_ranges(tb.chapters(spark, d)).withColumn("key", F.concat_ws(":", F.col("doc").cast("string"), F.col("start").cast("string")))
    b = tb.blocks(spark, d).withColumn("lang", F.when(F.col("ord") % 2 == 0, "main").otherwise("other"))
    return reading.chapter_blocks(c, b, "main").drop("text")


@C.add(sql(tb.SQL_DOCS, search.TAXONOMY, search.SCOPED, select="SELECT scope, label, docs FROM (SELECT CASE WHEN work IS NULL THEN 'top:' || top WHEN sub IS NULL THEN 'work:' || work ELSE 'sub:' || work || '|' || sub END AS scope, CASE WHEN work IS NULL THEN 'The ' || top || '（全部）' WHEN sub IS NULL THEN 'Work ' || work ELSE 'Work ' || work || ' · ' || sub END AS label, count(DISTINCT doc) AS docs FROM scoped GROUP BY GROUPING SETS ((top), (top, work), (top, work, sub)))"))
def taxonomy(spark, d):
    """All scopes with labels and counts."""
    counts = sc.scope_counts(search._scope_docs(spark, d), search._taxonomy(spark, d))
    key = F.when(F.col("work").isNull(), F.concat(F.lit("top:"), "top")).when(F.col("sub").isNull(), F.concat(F.lit("work:"), "work")).otherwise(F.concat(F.lit("sub:"), "work", F.lit("|"), "sub"))
    scopes = counts.select(key.alias("scope"), "docs")
    t = search._taxonomy(spark, d)
    named = reading.scope_labels(scopes.select("scope"), t.select("top").distinct().withColumn("name", F.concat(F.lit("The "), "top")), t.select("work", F.concat(F.lit("Work "), "work").alias("label")))
    return named.join(scopes, "scope")


@C.add(sql(tb.SQL_ENTRIES, "t AS (SELECT leaf, term, count(*) AS n, min(cat) AS cat FROM entries WHERE contains(term, 'e') GROUP BY ALL)", select="SELECT leaf, term, n, cat, row_number() OVER w AS place, count(*) OVER (PARTITION BY leaf) AS total, count(*) OVER (PARTITION BY leaf, cat) AS of_cat FROM t WINDOW w AS (PARTITION BY leaf ORDER BY CASE cat WHEN 'en' THEN 0 ELSE 30 END, n DESC, length(term), term) QUALIFY place <= 20"))
def glossary_leaf(spark, d):
    """The first page of every leaf with counts of its categories."""
    return glossary.leaf_page(tb.entries(spark, d), "e", {"en": 0}, 30, 0, 20)


@C.add(sql(tb.SQL_DOCS, select="SELECT doc, title, work, file, CASE WHEN kind = 'de' THEN 'translator ' || work ELSE 'given' END AS translator FROM docs"))
def source_rows(spark, d):
    """The source of every document as one value."""
    x = tb.docs(spark, d).withColumns({"meta": F.create_map(F.lit("translator"), F.lit("given")), "translator": F.when(F.col("kind") == "de", F.concat(F.lit("translator "), "work"))})
    return reading.source_struct(x).select("doc", "source.title", "source.work", "source.file", F.col("source.meta")["translator"].alias("translator"))


@C.add(sql(*search.WORD_HITS, tb.SQL_DOCS, tb.SQL_LOCATED, select="SELECT query_id, work, doc, ord, n, CASE WHEN path = 'upper' THEN path ELSE title END AS path FROM hits JOIN docs USING (doc) JOIN located USING (doc, ord)"))
def occurrence_rows(spark, d):
    """Passages as they are shown; one without a path has its title."""
    x = tb.docs(spark, d).withColumns({"meta": F.expr("cast(null as map<string,string>)"), "translator": F.lit("")})
    loc = tb.located(spark, d).withColumn("path", F.when(F.col("path") == "upper", "upper").otherwise(""))
    return reading.occurrence_rows(search._hits(spark, d), x, loc).drop("source")


@C.add(sql(tb.SQL_DOCS, select="SELECT doc FROM docs WHERE kind IN ('de', 'en') AND starts_with(file, 'src1/')"))
def interview_sources(spark, d):
    """Documents of interview kinds under a path."""
    return tb.docs(spark, d).where(reading.is_interview_source(F.col("kind"), F.col("file"), ("de", "en"), "src1/")).select("doc")


INDEX = """tag AS (SELECT doc, ord, text, CASE WHEN len(regexp_extract_all(text, '[à-öø-ÿœ]')) > 0 AND len(regexp_extract_all(text, '[à-öø-ÿœ]')) / greatest(1, len(regexp_extract_all(text, '[à-öø-ÿœ]')) + len(regexp_extract_all(text, '[a-z]'))) >= 0.05 THEN 'rom' ELSE 'plain' END AS lang FROM blocks WHERE doc NOT IN (SELECT doc FROM docs WHERE work = 'src4') AND trim(text, ' ') <> ''),
    vis AS (SELECT * FROM tag WHERE lang = 'plain'), keyed AS (SELECT doc, lower(regexp_replace(string_agg(text, chr(10) ORDER BY ord), '[\\s　]+', '', 'g')) AS k FROM vis GROUP BY doc),
    copies AS (SELECT doc FROM (SELECT doc, k, doc IN (SELECT doc FROM chapters) AS st FROM keyed WHERE k <> '') QUALIFY NOT st AND doc <> first_value(doc) OVER (PARTITION BY k ORDER BY NOT st, doc)),
    kept AS (SELECT * FROM vis WHERE doc NOT IN (SELECT doc FROM copies)),
    pathed AS (SELECT k.doc, ord, coalesce(nullif(l.title, ''), work || CASE WHEN d.title <> '' AND d.title <> work THEN ' › ' || d.title ELSE '' END) AS path FROM kept k JOIN docs d USING (doc) LEFT JOIN (SELECT doc, start, lead(start) OVER (PARTITION BY doc ORDER BY start) AS stop, title FROM chapters) l ON l.doc = k.doc AND ord >= start AND (stop IS NULL OR ord < stop)),
    runs AS (SELECT *, sum(f) OVER (PARTITION BY doc ORDER BY ord) AS run FROM (SELECT *, CASE WHEN lag(path) OVER w = path AND lag(ord) OVER w = ord - 1 THEN 0 ELSE 1 END AS f FROM pathed WINDOW w AS (PARTITION BY doc ORDER BY ord)))"""


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_DOCS, tb.SQL_CHAPTERS, INDEX, select="SELECT doc, path, min(ord) AS start, max(ord) + 1 AS \"end\" FROM runs GROUP BY doc, run, path"))
def build_index(spark, d):
    """The locations of the index: sources chosen, split by language, copies left out, located, compacted. Cleaning has its own query."""
    b = tb.blocks(spark, d)
    late = b.where("ord < 0").select("doc", F.lit(0).alias("priority"), F.lit("late").alias("source"), "ord", "text")
    candidates = late.unionByName(b.select("doc", F.lit(1).alias("priority"), F.lit("base").alias("source"), "ord", "text"))
    gone = tb.docs(spark, d).where("work = 'src4'").select("doc", F.lit("other edition").alias("reason"))
    chapters = story.close_ranges(tb.chapters(spark, d)).select("doc", "start", "end", F.col("title").alias("path"))
    return build.build_index(candidates, tb.docs(spark, d), gone, chapters, lambda t: t, part=lg.ACCENTED, whole="[a-z]", foreign="rom", main="plain", least=0.05)["locations"]


@C.add(sql(tb.SQL_BLOCKS, search.TAGGED, search.RUNS, "p AS (SELECT * FROM (SELECT *, lead(lang) OVER (PARTITION BY doc ORDER BY run) AS nxt FROM runs) WHERE NOT (lang = 'rom' AND coalesce(nxt, '') = 'plain'))", "q AS (SELECT *, min(CASE WHEN lang = 'plain' THEN run END) OVER (PARTITION BY doc) AS f, max((lang <> 'plain')::INT) OVER (PARTITION BY doc) AS two FROM p)", select="SELECT doc, run AS ord, lang FROM q WHERE f IS NULL OR two = 0 OR run >= f"))
def repair_sources(spark, d):
    """Runs that are left of bilingual documents."""
    x = tb.table(spark, d, "documents").select("doc_id", "text")
    return build.repair_sources(x, lg.ACCENTED, "[a-z]", "rom", "plain", 0.05).drop("text")


ROUTES = """e AS (SELECT p_brand AS route, p_name AS name, p_partkey AS ord FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, CASE WHEN p_size < 10 THEN p_type ELSE '=' || p_partkey END ORDER BY p_partkey) = 1),
    f AS (SELECT min(p_partkey) AS doc, upper(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) AS k FROM part WHERE p_retailprice < 1500 GROUP BY 2),
    o AS (SELECT p_name AS name, max(p_partkey) AS doc FROM part WHERE p_size = 1 GROUP BY 1 HAVING count(*) > 1),
    t AS (SELECT p_name AS name, min(p_type) AS title FROM part WHERE p_name < 'm' GROUP BY 1),
    x AS (SELECT route, name, coalesce(title, name) AS shown, ord, coalesce(o.doc, f.doc) AS doc FROM e LEFT JOIN o USING (name) LEFT JOIN f ON upper(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) = k LEFT JOIN t USING (name)),
    y AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ord) AS n FROM x WHERE doc IS NOT NULL)"""


@C.add(sql(ROUTES, select="SELECT route, doc, CASE WHEN n < 10 THEN '0' ELSE '' END || n || ' ' || shown AS title, n AS main_index, 'W::' || route || '::' || (n - 1) AS key FROM y"))
def build_routes(spark, d):
    """C17: chapters of routes from an event table, some documents and titles by curated tables."""
    p = tb.table(spark, d, "part")
    events = p.select(F.lit("W").alias("work"), F.col("p_brand").alias("route"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") < 10, F.col("p_type")).alias("merge"))
    docs = p.where("p_retailprice < 1500").select(F.col("p_partkey").alias("doc"), F.concat(F.lit("dir/"), "p_name", F.lit(".txt")).alias("file"))
    overrides = p.where("p_size = 1").groupBy(F.col("p_name").alias("name")).agg(F.max("p_partkey").alias("doc"), F.count("*").alias("n")).where("n > 1").drop("n")
    titles = p.where("p_name < 'm'").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("title"))
    return build.build_routes(events, docs, overrides, titles).select("route", "doc", "title", "main_index", "key")


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_DOCS, "o AS (SELECT doc, ord, len, sum(len + 1) OVER (ORDER BY doc, ord) - (len + 1) AS s FROM blocks)", select="SELECT doc, ord, CAST(s AS BIGINT) AS start, len FROM o WHERE doc IN (SELECT doc FROM docs WHERE work = 'src1') OR s + len > 100000"))
def quality_outside(spark, d):
    """Q08: offsets of unknown documents or beyond the corpus."""
    from corpusq.operators.blocks import with_offsets

    o = with_offsets(tb.blocks(spark, d)).select("doc", "ord", "start", "len")
    return quality.outside_corpus(o, tb.docs(spark, d).where("work <> 'src1'").select("doc"), 100_000)


@C.add(sql(tb.SQL_BLOCKS, search.TAGGED, select="SELECT doc, ord FROM tagged WHERE lang = 'plain'"))
def quality_language(spark, d):
    """Q03: blocks of the main language in a foreign table."""
    return quality.wrong_language(search._tagged(spark, d), "plain")


@C.add(sql(tb.SQL_CHAPTER_ROWS, "n AS (SELECT work, route, count(*) AS n FROM story GROUP BY ALL)", select="SELECT work, route, CAST(60 AS BIGINT) AS expected, n FROM n WHERE n <> 60"))
def quality_chapters(spark, d):
    """Q09: routes with another number of chapters than expected."""
    c = tb.story_chapters(spark, d)
    return quality.wrong_chapter_count(c, c.select("work", "route").distinct().withColumn("expected", F.lit(60)))


@C.add(sql(select="SELECT p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 5 = 0, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'g' || lpad((p_size % 5)::VARCHAR, 12, '0') END, 'n' || lpad(p_partkey::VARCHAR, 12, '0')) AS place FROM part"))
def route_order(spark, d):
    """Files in the order of their route, ungrouped last."""
    p = tb.table(spark, d, "part")
    f = p.select(F.col("p_brand").alias("work"), F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("g"), (F.col("p_size") % 5).cast("string"))).alias("grp"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"), "p_partkey")
    return story.route_order(f).select(F.col("p_partkey").alias("name"), "place")


@C.add(sql(tb.SQL_DOCS, select="SELECT doc, 'merged text' AS reason, array_to_string((SELECT list(doc ORDER BY doc) FROM docs c WHERE c.work = 'src2' AND c.kind = 'en'), '|') AS canonical FROM docs WHERE contains(file, 'src1/de')"))
def merged_exclusions(spark, d):
    """Merged texts with the chapters of their route."""
    x = tb.docs(spark, d)
    rules = spark.createDataFrame([("src1/de", "src2", "en")], "part string, work string, route string")
    found = story.merged_exclusions(x, rules, x.select("work", F.col("kind").alias("route"), "doc"))
    return found.select("doc", "reason", F.array_join("canonical_docs", "|").alias("canonical"))


@C.add(sql("e AS (SELECT s_suppkey AS ord, s_name AS name FROM supplier)", select="SELECT ord, CASE WHEN ord = 3 THEN 1 ELSE ord END AS doc FROM e"))
def event_documents(spark, d):
    """Documents of event rows by stem, one by override."""
    s = tb.table(spark, d, "supplier")
    events = s.select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"))
    docs = s.select(F.col("s_suppkey").alias("doc"), F.concat(F.lit("x/"), "s_name", F.lit(".txt")).alias("file"))
    return story.event_documents(events, docs, events.where("ord = 3").select("name", F.lit(1).cast("long").alias("doc"))).select("ord", "doc")
