"""Queries over blocks, terms, occurrences, scopes and aliases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusq.functions import lang as lg
from corpusq.functions import text as tx
from corpusq.functions.positions import match_positions
from corpusq.operators import aliases as al
from corpusq.operators import blocks as bl
from corpusq.operators import multiterm as mt
from corpusq.operators import occurrences as oc
from corpusq.operators import scope as sc
from corpusq.operators import suggest as sg
from corpusq.operators.suffixes import names_with
from corpusq.plans import tables as tb
from corpusq.plans.registry import Catalog
from corpusq.plans.tables import sql

C = Catalog()
HITS = "hits AS (SELECT query_id, words.term, doc, ord, count(*) AS n FROM tokens JOIN words ON t = lower(words.term) GROUP BY ALL)"
WORD_HITS = (tb.SQL_BLOCKS, tb.SQL_TOKENS, tb.SQL_TERMS, tb.SQL_WORDS, HITS)
WORDS = [t for t in tb.TERMS if " " not in t[1]]


def _hits(spark, d):
    return oc.occurrences(tb.terms(spark, WORDS), tb.blocks(spark, d), positions=False)


@C.add(sql(tb.SQL_BLOCKS, select="SELECT doc, ord, text, len FROM blocks"))
def blocks(spark, d):
    """Lines of documents."""
    return tb.blocks(spark, d)


@C.add(sql(tb.SQL_BLOCKS, select="SELECT doc, ord, len, CAST(sum(len + 1) OVER (ORDER BY doc, ord) - (len + 1) AS BIGINT) AS start FROM blocks"))
def block_offsets(spark, d):
    """Running offsets in two levels."""
    return bl.with_offsets(tb.blocks(spark, d)).select("doc", "ord", "len", "start")


@C.add(sql(tb.SQL_BLOCKS, "o AS (SELECT doc, ord, len, sum(len + 1) OVER (ORDER BY doc, ord) - (len + 1) AS start FROM blocks)", select="SELECT doc, CAST(min(start) AS BIGINT) AS first, CAST(max(start + len) AS BIGINT) AS last FROM o GROUP BY doc"))
def document_spans(spark, d):
    """A04."""
    return bl.document_spans(bl.with_offsets(tb.blocks(spark, d)))


@C.add(sql(select="SELECT doc_id AS doc, CAST(unnest(range(len(p))) AS BIGINT) AS ord, unnest(p) AS text FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)"))
def paragraphs(spark, d):
    """F24."""
    return bl.split_paragraphs(tb.table(spark, d, "documents"))


SQL_HEADING = """h AS (SELECT doc, ord, trim(text, ' ') AS title FROM headed), i AS (SELECT *, regexp_matches(title, '(?i)^(?:序|序幕|开幕|终章|尾声|幕间|间章|后记|あとがき|prologue|epilogue|chapter|act|track|disc|intro|outro|final|第[0-9一二三四五六七八九十百千]+(?:章|节|幕|话|回|夜|部))') AS hinted FROM h),
    heads AS (SELECT doc, ord, title FROM i WHERE length(title) BETWEEN 2 AND 24 AND NOT regexp_matches(title, '^[0-9０-９]+[：:.．]|^未知$|^[#*\\-—・◇◆\\s]+$|^[（(]|^https?:|^译者|^录入|^翻译|^插画|^修图|^校对|^扫图')
        AND NOT regexp_matches(title, '[。，、！？…；：:!?【「『\\[\\]{}<>|\\\\^~$#@*_=+%&]') AND (regexp_matches(title, '[\\x{4e00}-\\x{9fff}]') OR hinted) AND (hinted OR regexp_matches(title, '（\\d+/\\d+）$') OR length(title) <= 14))"""


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_HEADED, SQL_HEADING, select="SELECT doc, ord, title, row_number() OVER (PARTITION BY doc ORDER BY ord) AS n FROM heads QUALIFY n <= 300"))
def toc(spark, d):
    """Heading lines of each document."""
    return bl.toc(tb.headed_blocks(spark, d))


@C.add(sql(*WORD_HITS, select="SELECT query_id, doc, ord, n FROM hits"))
def occurrence_hits(spark, d):
    """Hits of each term in each block, one scan."""
    return _hits(spark, d).select("query_id", "doc", "ord", "n")


@C.add(sql(*WORD_HITS, select="SELECT query_id, doc, ord, n FROM hits"))
def occurrence_index(spark, d):
    """The same by the gram index."""
    return oc.index_occurrences(tb.terms(spark, WORDS), tb.blocks(spark, d), positions=False).select("query_id", "doc", "ord", "n")


STATS = """SELECT query_id, work, CAST(sum(n) AS BIGINT) AS hits, count(*) AS segments, count(DISTINCT doc) AS docs FROM hits JOIN docs USING (doc) GROUP BY GROUPING SETS ((query_id, work), (query_id))"""


@C.add(sql(*WORD_HITS, tb.SQL_DOCS, select=STATS))
def occurrence_stats(spark, d):
    """Hits, segments and documents by work."""
    return oc.occurrence_stats(_hits(spark, d), tb.docs(spark, d))


@C.add(sql(tb.SQL_BLOCKS, select="SELECT doc, ord, len(regexp_extract_all(text, 'the')) AS n, strpos(text, 'the') - 1 AS first FROM blocks WHERE contains(text, 'the')"))
def match_places(spark, d):
    """Number and first of all match positions."""
    b = tb.blocks(spark, d).withColumn("p", match_positions(F.col("text"), "the")).where(F.size("p") > 0)
    return b.select("doc", "ord", F.size("p").alias("n"), F.array_min("p").alias("first"))


@C.add(sql(*WORD_HITS, tb.SQL_DOCS, select="SELECT query_id, doc, ord, n, work, kind, row_number() OVER (PARTITION BY query_id ORDER BY kind, doc, ord) AS rank FROM hits JOIN docs USING (doc) WHERE work = 'src3'"))
def occurrence_listing(spark, d):
    """Listing of one work in order."""
    return oc.listing(_hits(spark, d).drop("term"), tb.docs(spark, d), "src3").select("query_id", "doc", "ord", "n", "work", "kind", "rank")


@C.add(sql(*WORD_HITS, select="""SELECT query_id, doc, ord, n, total, passages, passages > 100 OR total > 300 AS truncated FROM (SELECT query_id, doc, ord, n, CAST(sum(n) OVER (PARTITION BY query_id) AS BIGINT) AS total, count(*) OVER (PARTITION BY query_id) AS passages,
    row_number() OVER (PARTITION BY query_id ORDER BY doc, ord) AS rank, sum(n) OVER (PARTITION BY query_id ORDER BY doc, ord) AS upto FROM hits) WHERE rank <= 100 AND upto - n < 300"""))
def occurrence_caps(spark, d):
    """Bounded listing, everything counted."""
    return oc.capped(_hits(spark, d), 100, 300).select("query_id", "doc", "ord", "n", "total", "passages", "truncated")


PLACED = """placed AS (SELECT query_id, doc, ord, n, work, kind_rank, row_number() OVER (PARTITION BY query_id, work ORDER BY kind_rank, CASE WHEN r > 1 THEN 1 ELSE 0 END, doc, ord) AS place FROM
    (SELECT h.*, work, CASE kind WHEN 'en' THEN CAST(0 AS BIGINT) WHEN 'de' THEN 1 ELSE 4 END AS kind_rank, row_number() OVER (PARTITION BY query_id, work, CASE kind WHEN 'en' THEN CAST(0 AS BIGINT) WHEN 'de' THEN 1 ELSE 4 END, doc ORDER BY ord) AS r FROM hits h JOIN docs USING (doc)))"""


def _placed(spark, d):
    h = _hits(spark, d).drop("term").join(tb.docs(spark, d).select("doc", "work", "kind"), "doc")
    return oc.diversify(h.withColumn("kind_rank", F.when(F.col("kind") == "en", 0).when(F.col("kind") == "de", 1).otherwise(4)))


@C.add(sql(*WORD_HITS, tb.SQL_DOCS, PLACED, select="SELECT query_id, doc, ord, work, kind_rank, place FROM placed"))
def diversify(spark, d):
    """Kinds in order, each document once before repeats."""
    return _placed(spark, d).select("query_id", "doc", "ord", "work", "kind_rank", "place")


@C.add(sql(*WORD_HITS, tb.SQL_DOCS, PLACED, select="SELECT query_id, doc, ord, work, place, row_number() OVER (PARTITION BY query_id ORDER BY place, work) AS pick FROM placed WHERE place <= 8 QUALIFY pick <= 40"))
def round_robin(spark, d):
    """Works in turn."""
    return oc.round_robin(_placed(spark, d).withColumn("work_rank", F.lit(0)), 40).select("query_id", "doc", "ord", "work", "place", "pick")


@C.add(sql(select="SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z0-9])re')"))
def word_start(spark, d):
    """Names with a word that begins with the query."""
    return tb.table(spark, d, "part").where(tx.word_start(F.col("p_name"), F.lit("re"))).select("p_partkey", "p_name")


@C.add(sql(select="SELECT doc_id, contains(lower(text), 'sch') AS has_part, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS has_word FROM documents"))
def word_match(spark, d):
    """Substring and whole-word tests."""
    t = F.col("text")
    return tb.table(spark, d, "documents").select("doc_id", tx.contains_ci(t, F.lit("SCH")).alias("has_part"), tx.word_match(t, F.lit("The")).alias("has_word"))


@C.add(sql(select="""SELECT term, regexp_matches(term, '[A-Za-z]') AS latin, CASE WHEN regexp_matches(term, '[A-Za-z]') THEN '(?<![A-Za-z0-9])' || b || '(?![A-Za-z0-9])' ELSE b END AS pattern
    FROM (SELECT term, replace(term, ' ', '[·・‧．.\\s]*') AS b FROM (SELECT p_name AS term FROM part UNION SELECT p_brand FROM part UNION SELECT p_size::VARCHAR FROM part UNION SELECT c_name FROM customer))"""))
def term_patterns(spark, d):
    """Script and tolerant pattern of all names, brands and sizes."""
    p, c = tb.table(spark, d, "part"), tb.table(spark, d, "customer")
    t = p.select(F.col("p_name").alias("term")).union(p.select("p_brand")).union(p.select(F.col("p_size").cast("string"))).union(c.select("c_name")).distinct()
    return t.select("term", tx.is_latin(F.col("term")).alias("latin"), tx.term_pattern(F.col("term")).alias("pattern"))


TAXONOMY = "taxonomy AS (SELECT 'top' || (CAST(substr(work, 4) AS INT) % 3)::VARCHAR AS top, work FROM (SELECT DISTINCT source AS work FROM documents))"
SCOPED = "scoped AS (SELECT doc_id AS doc, source AS work, lang AS sub, top FROM documents JOIN taxonomy ON work = source)"


def _scope_docs(spark, d):
    return tb.docs(spark, d).select("doc", "work", F.col("kind").alias("sub"))


def _taxonomy(spark, d):
    works = tb.docs(spark, d).select("work").distinct()
    return works.select(F.concat(F.lit("top"), (F.substring("work", 4, 9).cast("int") % 3).cast("string")).alias("top"), "work")


@C.add(sql(TAXONOMY, SCOPED, select="SELECT top, work, sub, count(DISTINCT doc) AS docs FROM scoped GROUP BY GROUPING SETS ((top), (top, work), (top, work, sub))"))
def scope_rollup(spark, d):
    """Documents of every scope."""
    return sc.scope_counts(_scope_docs(spark, d), _taxonomy(spark, d))


@C.add(sql(tb.SQL_DOCS, TAXONOMY, SCOPED, select="""SELECT query_id, doc FROM docs, (VALUES (CAST(1 AS BIGINT), ''), (2, 'top:top1'), (3, 'work:src2'), (4, 'sub:src2|en'), (5, 'work:none')) v(query_id, scope)
    WHERE scope = '' OR (scope = 'top:top1' AND doc IN (SELECT doc FROM scoped WHERE top = 'top1')) OR (scope = 'work:src2' AND work = 'src2') OR (scope = 'sub:src2|en' AND work = 'src2' AND kind = 'en')"""))
def in_scope(spark, d):
    """An unknown key gives no rows."""
    asked = spark.createDataFrame([(1, ""), (2, "top:top1"), (3, "work:src2"), (4, "sub:src2|en"), (5, "work:none")], "query_id long, scope string")
    rows = tb.docs(spark, d).select("doc").crossJoin(F.broadcast(asked))
    return sc.in_scope(rows, sc.scopes(_scope_docs(spark, d), _taxonomy(spark, d))).select("query_id", "doc")


@C.add(sql(tb.SQL_DOCS, select="SELECT doc, work, CASE WHEN work = 'src1' AND contains(file, '/de/') THEN 'german' WHEN work = 'src1' AND contains(file, '/e') THEN 'other e' WHEN work = 'src1' THEN 'rest' END AS sub FROM docs"))
def sub_of(spark, d):
    """first rule wins, default per work."""
    rules = spark.createDataFrame([("src1", 1, "/de/", "german"), ("src1", 2, "/e", "other e"), ("src1", 9, None, "rest")], "work string, ord int, part string, label string")
    return sc.sub_of(tb.docs(spark, d), rules).select("doc", "work", "sub")


@C.add(sql(select="SELECT coalesce(nullif(p_brand, ''), '未分类') AS cat, count(*) AS n FROM part WHERE contains(lower(p_name), 'a') GROUP BY ALL"))
def facet_counts(spark, d):
    """A08, P09."""
    return sc.facet_counts(tb.table(spark, d, "part"), "A", cat="p_brand", name="p_name")


@C.add(sql(select="SELECT p_partkey, p_brand FROM part WHERE contains(lower(p_name), 'e') AND p_brand = (SELECT min(p_brand) FROM part)"))
def leaf_filter(spark, d):
    """One category of a leaf page."""
    p = tb.table(spark, d, "part")
    first = p.agg(F.min("p_brand")).first()[0]
    return sc.filter_leaf(p, "e", first, cat="p_brand", name="p_name").select("p_partkey", "p_brand")


@C.add(sql(select="SELECT r_name AS top, n_name AS work, c_mktsegment AS sub, count(*) AS n, count(DISTINCT (r_name, n_name, c_mktsegment)) AS leaves FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (r_name, n_name, c_mktsegment))"))
def tree_counts(spark, d):
    """Counts of all nodes of a three-level tree."""
    c = tb.table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    n = tb.table(spark, d, "nation").join(tb.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("top"), F.col("n_name").alias("work"), F.col("c_mktsegment").alias("sub"), "n")
    return sc.tree_counts(leaves)


NODES = """nodes AS (SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS n FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation)"""


@C.add(sql(NODES, select="SELECT a.node, CAST(sum(b.n) AS BIGINT) AS n FROM nodes a JOIN nodes b ON b.node = a.node OR b.parent = a.node GROUP BY a.node"))
def chapter_counts(spark, d):
    """Counts up a tree of any depth."""
    c = tb.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    nation = tb.table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.coalesce("n", F.lit(0)).alias("n"))
    region = tb.table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("n"))
    return sc.count_tree(region.unionByName(nation))


@C.add(sql(select="SELECT o_orderkey AS node, count(*) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey DESC) AS n FROM orders"))
def deep_tree_counts(spark, d):
    """Counts up trees as deep as the orders of a fiftieth of the customers are many."""
    w = Window.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderkey")
    nodes = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(w).alias("parent"), F.lit(1).alias("n"))
    return sc.count_tree(nodes)


@C.add(sql(select="SELECT p_brand, p_partkey, row_number() OVER w AS n, count(*) OVER (PARTITION BY p_brand) AS total, count(*) OVER (PARTITION BY p_brand) > 15 AS has_more FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_name, p_partkey) QUALIFY n > 5 AND n <= 15"))
def paging(spark, d):
    """Page of every brand with total."""
    p = tb.table(spark, d, "part")
    return sc.page(p, [F.col("p_name"), F.col("p_partkey")], 5, 10, ["p_brand"]).select("p_brand", "p_partkey", "n", "total", "has_more")


ASKED = (tb.SQL_LONG_WORDS, tb.SQL_WORD_ALIASES, tb.SQL_WORD_QUERIES)
BEST = """found AS (SELECT query_id, q, nick, targets, priority, 2 + CASE WHEN nick = q THEN 0 ELSE 1 END AS way FROM asked JOIN aliases ON lower(nick) = lower(q)
    UNION ALL SELECT query_id, q, nick, targets, priority, CASE WHEN t = q THEN 0 ELSE 1 END FROM asked JOIN (SELECT *, unnest(targets) AS t FROM aliases) ON lower(t) = lower(q)),
    best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY way, priority, nick) = 1)"""


@C.add(sql(*ASKED, BEST, select="SELECT a.query_id, a.q, nick, array_to_string(targets, '|') AS targets FROM asked a LEFT JOIN best USING (query_id)"))
def resolve_alias(spark, d):
    """Cascade of exact and case-insensitive targets and nicks."""
    return al.resolve_alias(tb.word_queries(spark, d), tb.word_aliases(spark, d)).withColumn("targets", F.array_join("targets", "|"))


@C.add(sql(*ASKED, BEST, select="SELECT a.query_id, a.q, CASE WHEN len(targets) = 1 AND targets[1] <> a.q THEN targets[1] ELSE a.q END AS text, CASE WHEN len(targets) = 1 AND targets[1] <> a.q THEN nick || '→' || targets[1] END AS note FROM asked a LEFT JOIN best USING (query_id)"))
def apply_alias(spark, d):
    """whole-query replacement by a single target."""
    return al.apply_alias(tb.word_queries(spark, d), tb.word_aliases(spark, d))


@C.add(sql(select="SELECT doc_id, array_to_string(CASE WHEN len(p) >= 2 THEN p ELSE [] END, '|') AS parts, len(CASE WHEN len(p) >= 2 THEN p ELSE [] END) AS n FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,，;；|｜、\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents)"))
def split_terms(spark, d):
    """parts of a multi-term text."""
    p = tx.split_terms(F.col("text"))
    return tb.table(spark, d, "documents").select("doc_id", F.array_join(p, "|").alias("parts"), F.size(p).alias("n"))


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_TOKENS, select="SELECT t, count(*) AS n FROM tokens GROUP BY t"))
def vocabulary(spark, d):
    """Term frequencies."""
    return sg.vocabulary(tb.blocks(spark, d))


RELATED = [(i, w) for i, w in enumerate(["the", "der", "und", "la", "de", "que", "and", "of", "die", "le"])]


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_TOKENS, f"held AS (SELECT DISTINCT doc, ord, t FROM tokens JOIN {tb.values(RELATED)} v(i, w) ON t = w)", select="SELECT a.t AS term, b.t AS other, count(*) AS n, row_number() OVER (PARTITION BY a.t ORDER BY count(*) DESC, b.t) AS place FROM held a JOIN held b USING (doc, ord) WHERE a.t <> b.t GROUP BY 1, 2 QUALIFY place <= 12"))
def related_terms(spark, d):
    """Terms that share blocks."""
    return sg.related_terms(tb.blocks(spark, d), tb.terms(spark, RELATED))


PHRASES = r"""phrases AS (SELECT DISTINCT regexp_extract(lower(text), '^[^a-z0-9]*([a-z]+ [a-z]+)(?:[^a-z0-9]|$)', 1) AS term FROM documents WHERE regexp_matches(lower(text), '^[^a-z0-9]*([a-z]+ [a-z]+)(?:[^a-z0-9]|$)')),
    spaced AS (SELECT doc, ord, lower(text) AS low, regexp_replace(lower(text), '([^a-z0-9])', '\1\1', 'g') AS wide FROM blocks),
    phrase_hits AS MATERIALIZED (SELECT term, doc, ord, len(regexp_extract_all(wide, '(?:^|[^a-z0-9])' || replace(term, ' ', '[·・‧．.\s]*') || '(?:[^a-z0-9]|$)')) AS n FROM phrases JOIN spaced ON contains(low, split_part(term, ' ', 1)) AND contains(low, split_part(term, ' ', 2))),
    phrase_held AS (SELECT * FROM phrase_hits WHERE n > 0)"""


def _phrases(spark, d):
    t = tb.table(spark, d, "documents").select(F.regexp_extract(F.lower("text"), "^[^a-z0-9]*([a-z]+ [a-z]+)(?:[^a-z0-9]|$)", 1).alias("term"))
    return t.where("term <> ''").distinct()


@C.add(sql(tb.SQL_BLOCKS, PHRASES, select="SELECT term AS t, CAST(sum(n) AS BIGINT) AS n, count(*) AS blocks FROM phrase_held GROUP BY term"))
def phrase_vocabulary(spark, d):
    """Frequencies of terms of two words, those that documents begin with."""
    return sg.term_vocabulary(sg.term_hits(tb.blocks(spark, d), _phrases(spark, d)))


@C.add(sql(tb.SQL_BLOCKS, PHRASES, select="SELECT a.term, b.term AS other, count(*) AS n, row_number() OVER (PARTITION BY a.term ORDER BY count(*) DESC, b.term) AS place FROM phrase_held a JOIN phrase_held b USING (doc, ord) WHERE a.term <> b.term GROUP BY 1, 2 QUALIFY place <= 12"))
def related_phrases(spark, d):
    """Terms of two words that share blocks."""
    b, t = tb.blocks(spark, d), _phrases(spark, d)
    return sg.related_terms(b, t, hits=sg.term_hits(b, t))


PREFIXES = [(1, "th"), (2, "an"), (3, "sch"), (4, "lic"), (5, "zzz")]


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_TOKENS, f"p AS (SELECT * FROM {tb.values(PREFIXES)} v(query_id, q))", select="SELECT query_id, t, count(*) AS n, CAST(0 AS BIGINT) AS tier, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, length(t), t) AS place FROM tokens JOIN p ON starts_with(t, q) GROUP BY query_id, t QUALIFY place <= 10"))
def suggest_topk(spark, d):
    """Completions by an index of beginnings."""
    return sg.suggest_raw(tb.asked(spark, PREFIXES), sg.vocabulary(tb.blocks(spark, d))).select("query_id", "t", "n", "tier", "place")


SQL_NAMED = """named AS (SELECT c_name AS t, 1 AS n FROM customer UNION ALL SELECT p_name, count(*) FROM part GROUP BY p_name),
    asked AS (SELECT row_number() OVER (ORDER BY q) AS query_id, q FROM (SELECT p_size::VARCHAR AS q FROM part UNION SELECT substr(p_name, 3, 4) FROM part UNION SELECT upper(split_part(p_name, ' ', 2)) FROM part UNION SELECT lower(r_name) FROM region) WHERE q <> ''),
    hit AS (SELECT query_id, q, t, n, lower(t) AS l, regexp_matches(q, '[A-Za-z]') AS latin, CASE WHEN regexp_matches(q, '[A-Za-z]') THEN CASE WHEN starts_with(lower(t), lower(q)) THEN 1 ELSE instr(regexp_replace(lower(t), '[^a-z0-9]', ' ', 'g'), ' ' || regexp_replace(lower(q), '[^a-z0-9]', ' ', 'g')) + 1 END ELSE instr(lower(t), lower(q)) END AS pos
        FROM asked, named WHERE CASE WHEN regexp_matches(q, '[A-Za-z]') THEN regexp_matches(lower(t), '(^|[^a-z0-9])' || lower(q)) ELSE contains(lower(t), lower(q)) END)"""


def _named(spark, d):
    c, p, r = (tb.table(spark, d, t) for t in ("customer", "part", "region"))
    names = c.select(F.col("c_name").alias("t"), F.lit(1).cast("long").alias("n")).unionByName(p.groupBy(F.col("p_name").alias("t")).agg(F.count("*").alias("n")))
    pieces = [p.select(F.col("p_size").cast("string").alias("q")), p.select(F.substring("p_name", 3, 4).alias("q")), p.select(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("q")), r.select(F.lower("r_name").alias("q"))]
    q = pieces[0]
    for x in pieces[1:]:
        q = q.union(x)
    w = Window.partitionBy(F.lit(0)).orderBy("q")
    return q.distinct().where("q <> ''").select(F.row_number().over(w).cast("long").alias("query_id"), "q"), names


@C.add(sql(SQL_NAMED, select="SELECT query_id, t AS name FROM hit"))
def name_search(spark, d):
    """All names of customers and parts that hold the sizes, pieces of names and regions, inside too."""
    q, names = _named(spark, d)
    return names_with(q, names.select(F.col("t").alias("name"))).select("query_id", "name")


@C.add(sql(SQL_NAMED, "tiered AS (SELECT *, CASE WHEN pos = 1 THEN 0 WHEN latin AND regexp_matches(substr(l, pos + length(q), 1), '[a-z0-9]') THEN 2 ELSE 1 END AS tier FROM hit)", select="SELECT query_id, t, n, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, n DESC, length(t), t) AS place FROM tiered QUALIFY place <= 10"))
def suggest_names(spark, d):
    """Completions of the same queries by tiers: start, whole word or inside, start of a longer word."""
    q, names = _named(spark, d)
    return sg.suggest_raw(q, names)


UNITS = """toks AS (SELECT query_id, doc, ord, g FROM (SELECT DISTINCT doc, ord, t FROM tokens) JOIN grp ON t = term GROUP BY ALL),
    units AS (SELECT query_id, doc, ord, CAST(bit_or(CAST(1 AS BIGINT) << g::INT) AS BIGINT) AS mask FROM toks GROUP BY ALL),
    lv AS (SELECT query_id, max(bit_count(mask)) AS level FROM units GROUP BY ALL)"""
U = (tb.SQL_BLOCKS, tb.SQL_TOKENS, tb.SQL_GROUPS, UNITS)


def _units(spark, d):
    return mt.match_units(tb.groups(spark), tb.blocks(spark, d))


@C.add(sql(*U, select="SELECT query_id, doc, ord, mask FROM units"))
def multi_term_mask(spark, d):
    """Groups that each block holds."""
    return _units(spark, d).select("query_id", "doc", "ord", "mask")


@C.add(sql(*U, select="SELECT query_id, CAST(level AS BIGINT) AS level FROM lv"))
def multi_term_level(spark, d):
    """A03."""
    return mt.effective_level(_units(spark, d))


@C.add(sql(*U, tb.SQL_DOCS, select="SELECT query_id, work, count(*) AS units, count(DISTINCT doc) AS docs FROM units JOIN lv USING (query_id) JOIN docs USING (doc) WHERE bit_count(mask) = level GROUP BY GROUPING SETS ((query_id, work), (query_id))"))
def multi_term_stats(spark, d):
    """A02."""
    return mt.unit_stats(_units(spark, d), tb.docs(spark, d))


def span_sql(blocks: str) -> str:
    """Spans of ``units`` over the texts of ``blocks(doc, ord, text)``, for up to three groups."""
    return f"""pieces AS (SELECT doc, ord, unnest(ps) AS t, unnest(range(len(ps))) AS i FROM (SELECT doc, ord, regexp_extract_all(lower(text), '[a-z0-9]+|[^a-z0-9]+') AS ps FROM {blocks} JOIN (SELECT DISTINCT doc, ord FROM units) USING (doc, ord))),
    words_at AS (SELECT doc, ord, t, sum(length(t)) OVER (PARTITION BY doc, ord ORDER BY i) - length(t) + 1 AS p FROM pieces),
    pos AS (SELECT query_id, doc, ord, g, p FROM words_at JOIN grp ON t = term),
    seen AS (SELECT *, max(CASE WHEN g = 0 THEN p END) OVER w AS a, max(CASE WHEN g = 1 THEN p END) OVER w AS b, max(CASE WHEN g = 2 THEN p END) OVER w AS c FROM pos WINDOW w AS (PARTITION BY query_id, doc, ord ORDER BY p)),
    spans AS (SELECT query_id, doc, ord, mask, CAST(min(CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT = bit_count(mask) THEN p - least(a, b, c) END) AS BIGINT) AS span FROM seen JOIN units USING (query_id, doc, ord) GROUP BY ALL)"""


SPAN = span_sql("blocks")


@C.add(sql(*U, SPAN, select="SELECT query_id, doc, ord, mask, span FROM spans"))
def shortest_span(spark, d):
    """Shortest window over the groups that a block holds."""
    return _units(spark, d).select("query_id", "doc", "ord", "mask", "span")


@C.add(sql(*U, SPAN, tb.SQL_DOCS, select="SELECT query_id, doc, ord, mask, span, row_number() OVER (PARTITION BY query_id ORDER BY span, work, doc, ord) AS rank FROM spans JOIN lv USING (query_id) JOIN docs USING (doc) WHERE bit_count(mask) = level QUALIFY rank <= 100"))
def multi_term_ranked(spark, d):
    """Matched units by span, best hundred."""
    return mt.ranked_units(_units(spark, d), tb.docs(spark, d), 100).select("query_id", "doc", "ord", "mask", "span", "rank")


@C.add()
def multi_term_fragments(spark, d):
    """Windows that hold the level."""
    return mt.fragments(_units(spark, d), tb.blocks(spark, d)).drop("text")


@C.add(sql(*U, select="SELECT query_id, doc, array_to_string(list(DISTINCT term ORDER BY term), '|') AS terms FROM toks JOIN grp USING (query_id, g) GROUP BY query_id, doc"))
def multi_term_labels(spark, d):
    """Matched terms of each document."""
    return mt.group_labels(_units(spark, d), tb.groups(spark)).withColumn("terms", F.array_join(F.array_sort("terms"), "|"))


ACCENT = "len(regexp_extract_all(coalesce(text, ''), '[à-öø-ÿœ]'))"
PLAIN = "len(regexp_extract_all(coalesce(text, ''), '[a-z]'))"


@C.add(sql(select=f"SELECT doc_id AS doc, length(coalesce(text, '')) AS chars, {ACCENT} AS n_part, {PLAIN} AS n_whole, round({ACCENT} / greatest(1, {ACCENT} + {PLAIN}), 3) AS share FROM documents"))
def language_profile(spark, d):
    """Share of accented letters."""
    return bl.language_profile(tb.table(spark, d, "documents"), lg.ACCENTED, "[a-z]")


TAGGED = f"""lines AS (SELECT doc, ord, text, CASE WHEN {ACCENT} = 0 AND {PLAIN} = 0 AND NOT regexp_matches(text, '[A-Za-z0-9]') THEN NULL WHEN {ACCENT} > 0 AND {ACCENT} / greatest(1, {ACCENT} + {PLAIN}) >= 0.05 THEN 'rom' WHEN {PLAIN} > 0 THEN 'plain' ELSE 'neutral' END AS l FROM blocks),
    tagged AS (SELECT doc, ord, text, coalesce(last_value(CASE WHEN l <> 'neutral' THEN l END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord), 'plain') AS lang FROM lines)"""


def _tagged(spark, d):
    return bl.tagged_lines(tb.blocks(spark, d), lg.ACCENTED, "[a-z]", "rom", "plain", 0.05)


@C.add(sql(tb.SQL_BLOCKS, TAGGED, select="SELECT doc, ord, lang FROM tagged"))
def line_languages(spark, d):
    """Language of each line, neutral lines filled."""
    return _tagged(spark, d).select("doc", "ord", "lang")


@C.add(sql(tb.SQL_BLOCKS, TAGGED, select="SELECT doc, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (lang = 'plain'), '') AS visible, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (lang <> 'plain'), '') AS \"foreign\" FROM tagged GROUP BY doc"))
def split_visible(spark, d):
    """Both languages of each document."""
    return bl.split_visible(_tagged(spark, d), "plain")


RUNS = "runs AS (SELECT doc, run, lang, min(ord) AS first_ord, max(ord) AS last_ord FROM (SELECT *, CAST(sum(f) OVER (PARTITION BY doc ORDER BY ord) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(lang) OVER (PARTITION BY doc ORDER BY ord) = lang THEN 0 ELSE 1 END AS f FROM tagged)) GROUP BY doc, run, lang)"


@C.add(sql(tb.SQL_BLOCKS, TAGGED, RUNS, select="SELECT * FROM runs"))
def language_runs(spark, d):
    """Runs of one language."""
    return bl.language_runs(_tagged(spark, d)).drop("text")


@C.add(sql(tb.SQL_BLOCKS, TAGGED, RUNS, select="SELECT doc, run, lang, first_ord, last_ord FROM (SELECT *, lead(lang) OVER (PARTITION BY doc ORDER BY run) AS nxt FROM runs) WHERE NOT (lang = 'rom' AND coalesce(nxt, '') = 'plain')"))
def paired_runs(spark, d):
    """Foreign runs that the main language repeats are dropped."""
    return bl.drop_paired_runs(bl.language_runs(_tagged(spark, d)), "rom", "plain").drop("text")


@C.add(sql(tb.SQL_BLOCKS, TAGGED, select="SELECT doc, ord FROM (SELECT *, min(CASE WHEN lang = 'plain' THEN ord END) OVER (PARTITION BY doc) AS f, max(CASE WHEN lang <> 'plain' THEN 1 ELSE 0 END) OVER (PARTITION BY doc) AS two FROM tagged) WHERE f IS NULL OR two = 0 OR ord >= f"))
def from_first_main(spark, d):
    """W08."""
    return bl.from_first_main(_tagged(spark, d), "plain").select("doc", "ord")


PIECES = r"""asked AS (SELECT item_id AS query_id, text AS q FROM benchmark),
    probe AS (SELECT query_id, size, pos, substr(q, pos + 1, size) AS part FROM (SELECT query_id, q, size, unnest(range(0, length(q) - size + 1, greatest(2, size // 3))) AS pos FROM asked, (VALUES (24), (20), (16), (12), (10), (8)) s(size) WHERE length(q) >= size)),
    good AS (SELECT * FROM probe WHERE len(regexp_extract_all(part, '[\x{4e00}-\x{9fff}A-Za-z0-9]')) >= 6),
    there AS (SELECT part, CAST(sum((length(text) - length(replace(text, part, ''))) // length(part)) AS BIGINT) AS n FROM (SELECT DISTINCT part FROM good), blocks WHERE contains(text, part) GROUP BY part),
    few AS (SELECT good.*, n FROM good JOIN there USING (part) QUALIFY row_number() OVER (PARTITION BY query_id, size ORDER BY pos) <= 4),
    sized AS (SELECT query_id, part, n FROM few f WHERE (SELECT count(*) FROM few g WHERE g.query_id = f.query_id AND g.size > f.size) < 6),
    special AS (SELECT query_id, 0 AS branch, row_number() OVER (PARTITION BY query_id ORDER BY length(part) DESC, n, part) AS o, part FROM (SELECT DISTINCT * FROM sized) QUALIFY o <= 8),
    freq AS (SELECT t, count(*) AS n FROM tokens GROUP BY t),
    inside AS (SELECT query_id, 2 AS branch, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, n, term) AS o, term FROM asked, (SELECT DISTINCT term, n FROM entries JOIN freq ON t = term) WHERE contains(lower(q), term) AND n <= 5000 QUALIFY o <= 8),
    clause AS (SELECT query_id, 3 AS branch, unnest(range(len(p))) AS o, unnest(p) AS part FROM (SELECT query_id, regexp_split_to_array(q, '[，。！？；：、\s“”‘’「」『』（）()\[\]【】]+') AS p FROM asked)),
    every AS (SELECT * FROM special UNION ALL SELECT * FROM inside UNION ALL SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY min(ord), target), target FROM asked JOIN rewrites ON contains(q, phrase) GROUP BY query_id, target UNION ALL SELECT * FROM clause WHERE length(part) >= 4),
    firsts AS (SELECT * FROM (SELECT query_id, branch, o, trim(part, '“”‘’「」『』 ') AS part FROM every) WHERE part <> '' QUALIFY row_number() OVER (PARTITION BY query_id, part ORDER BY branch, o) = 1)"""


@C.add(sql(tb.SQL_BLOCKS, tb.SQL_TOKENS, tb.SQL_ENTRIES, tb.SQL_LONG_WORDS, tb.SQL_WORD_REWRITES, PIECES, select="SELECT query_id, part, row_number() OVER (PARTITION BY query_id ORDER BY branch, o, part) AS place FROM firsts QUALIFY place <= 16"))
def fallback_parts(spark, d):
    """Pieces of all benchmark texts that the corpus has."""
    b, q = tb.blocks(spark, d), tb.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    terms = tb.entries(spark, d).select("term").distinct().join(sg.vocabulary(b).withColumnRenamed("t", "term"), "term")
    return sg.fallback_parts(q, b, terms, tb.word_rewrites(spark, d))


VARIANTS = """canon AS (SELECT a.query_id, a.q, targets, CASE WHEN len(targets) = 1 THEN targets[1] ELSE a.q END AS c FROM asked a LEFT JOIN best USING (query_id)),
    words AS (
        SELECT query_id, 0 AS branch, q AS term FROM canon UNION ALL SELECT query_id, 1, c FROM canon UNION ALL SELECT query_id, 2, unnest(targets) FROM canon
        UNION ALL SELECT query_id, 3, target FROM canon JOIN rewrites ON contains(q, phrase)
        UNION ALL SELECT query_id, 4, y.term FROM canon JOIN concepts x ON lower(x.term) = lower(c) JOIN concepts y USING (concept_id)
        UNION ALL SELECT query_id, 5, nick FROM canon JOIN (SELECT nick, unnest(targets) AS target FROM aliases) n ON lower(target) = lower(c) WHERE length(nick) >= 2 AND NOT contains(lower(c), lower(nick))),
    firsts AS (SELECT query_id, branch, term FROM words QUALIFY row_number() OVER (PARTITION BY query_id, lower(term) ORDER BY branch, term) = 1),
    variants AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY branch, term) AS ord, branch FROM firsts)"""
ALL_VARIANTS = (*ASKED, BEST, tb.SQL_WORD_REWRITES, tb.SQL_WORD_CONCEPTS, VARIANTS)


@C.add(sql(*ALL_VARIANTS, select="SELECT query_id, term, ord, branch FROM variants"))
def expand_terms(spark, d):
    """Variants of a query of every document: aliases, rewrites, concepts, nicks."""
    return al.expand_terms(tb.word_queries(spark, d), tb.word_aliases(spark, d), tb.word_concepts(spark, d), tb.word_rewrites(spark, d))


@C.add()
def suggest(spark, d):
    """The whole cascade for a few prefixes."""
    over = spark.createDataFrame([("th", ["theory"])], "phrase string, targets array<string>")
    return sg.suggest(tb.asked(spark, PREFIXES), tb.aliases(spark), over, tb.entries(spark, d).select("term"), sg.vocabulary(tb.blocks(spark, d)))
