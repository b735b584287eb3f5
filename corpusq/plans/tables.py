"""The engine's tables as built from the driver's parquet files, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.operators import blocks as bl
from corpusq.sources import ingest

#: Search terms of the sample queries: (query_id, q).
TERMS = [(1, "the"), (2, "der"), (3, "ci"), (4, "la"), (5, "attion"), (6, "license"), (7, "The and")]
#: Multi-term queries: groups of terms by query.
GROUPS = [(1, 0, "the"), (1, 1, "ing"), (2, 0, "der"), (2, 1, "und"), (2, 2, "ein"), (3, 0, "la"), (3, 1, "de"), (3, 2, "the"), (4, 0, "token"), (4, 1, "the")]
#: Aliases: (nick, targets, priority).
ALIASES = [("att", ["attion"], 1), ("Lic", ["license", "licence"], 1), ("lic", ["license"], 2), ("article", ["the"], 1), ("Der", ["der"], 3), ("die", ["der"], 3)]
#: Queries for aliases: (query_id, q).
ASKED = [(1, "att"), (2, "LIC"), (3, "license"), (4, "der"), (5, "nothing"), (6, "The")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc"), F.col("source").alias("work"), F.col("lang").alias("kind"), F.substring("text", 1, 24).alias("title"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("file"), F.col("n_chars").alias("chars"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.blocks_from_documents(table(spark, sf_dir, "documents"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per document: its first word of five or more letters, the text as body."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.withColumn("term", F.regexp_extract(F.lower("text"), "[a-z]{5,}", 0)).where("term <> ''")
    return d.select(
        F.col("doc_id").alias("entry_id"), F.col("doc_id").alias("doc"), "term", F.col("text").alias("body"), F.col("source").alias("leaf"), F.col("lang").alias("cat"),
        F.concat(F.lit("term:"), "term").alias("group_id"), F.col("lang").alias("meaning_id"), F.coalesce("quality", F.lit(0)).alias("definition_quality"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("is_primary"), (F.col("doc_id") % 97 == 0).alias("forced"), (F.col("doc_id") % 5).alias("version"), F.when(F.col("lang") == "en", "normal").when(F.col("lang") == "de", "special").otherwise("other").alias("bucket"), F.lit("").alias("variant_id"), F.col("doc_id").alias("card_id"),
    )


def pages_as_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.page_blocks(table(spark, sf_dir, "pages"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth block of a document that has ten or more begins a chapter; the title is its head."""
    b = blocks(spark, sf_dir)
    return b.where("ord % 10 = 0").select("doc", F.col("ord").alias("start"), F.substring("text", 1, 20).alias("title"))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with a path that changes with the first letter's case: runs of one path."""
    return blocks(spark, sf_dir).withColumn("path", F.when(F.col("text").rlike("^[A-Z]"), "upper").otherwise("other"))


def terms(spark: SparkSession, rows=TERMS) -> DataFrame:
    return spark.createDataFrame(rows, "query_id long, term string")


def asked(spark: SparkSession, rows=ASKED) -> DataFrame:
    return spark.createDataFrame(rows, "query_id long, q string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "nick string, targets array<string>, priority int")


def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, ws)``: the words of five or more letters of every document, in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)).alias("ws"))


def word_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first long word as a nick of its second one: ``(nick, targets, priority)``."""
    w = long_words(spark, sf_dir).where("size(ws) >= 2").select(F.get("ws", F.lit(0)).alias("nick"), F.get("ws", F.lit(1)).alias("target"), "doc_id").where("nick <> target")
    return w.groupBy("nick").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.min("doc_id").alias("priority"))


def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the first three long words of every document, every second one in capitals: ``(query_id, q)``."""
    w = long_words(spark, sf_dir).where("size(ws) >= 3")
    word = F.get("ws", (F.col("doc_id") % 3).cast("int"))
    return w.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 2 == 0, F.upper(word)).otherwise(word).alias("q"))


def word_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of the twenty commonest first words, with their plurals: a curated table ``(phrase, ord, targets)``."""
    top = long_words(spark, sf_dir).where("size(ws) >= 1").groupBy(F.get("ws", F.lit(0)).alias("t")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(20)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "t")
    return top.select(F.substring("t", 1, 4).alias("phrase"), F.row_number().over(w).alias("ord"), F.array(F.concat("t", F.lit("s"))).alias("targets"))


def word_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First long words; those with the same six letters in front are one concept: ``(term, concept_id)``."""
    t = F.get("ws", F.lit(0))
    return long_words(spark, sf_dir).where("size(ws) >= 1").select(t.alias("term"), F.substring(t, 1, 6).alias("concept_id")).distinct()


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, "query_id long, `group` int, term string")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusq.operators.qa import turns_to_qa

    return turns_to_qa(table(spark, sf_dir, "conversations"))


def headed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of all blocks as title lines, every third one named an act."""
    b = blocks(spark, sf_dir)
    return b.withColumn("text", F.concat(F.when(F.col("ord") % 3 == 0, "Act ").otherwise(""), F.substring("text", 1, 14)))


def spoken_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as blocks that begin with the speaker's role."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("ord"), F.concat_ws(": ", "role", "text").alias("text"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines of all pages, cut before headings and paragraphs."""
    d = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.split("html", "(?=<[hp])", -1)).alias("ord", "text"))
    return d.where("text <> ''")


def story_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as chapters: regions are works, nations routes, market segments groups; one region is official."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    d = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    bare = F.col("c_mktsegment") == "BUILDING"
    return d.select(F.col("r_name").alias("work"), F.col("n_name").alias("route"), F.col("n_nationkey").alias("route_ord"), F.when(bare, "").otherwise(F.col("c_mktsegment")).alias("grp"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("title"), F.col("c_custkey").alias("doc"),
                    (F.col("r_name") == "ASIA").alias("official"), F.lit(False).alias("extra"), F.when(F.col("c_acctbal") > 0, F.array(F.lit("first"), F.lit("second"))).otherwise(F.expr("cast(array() as array<string>)")).alias("sections"))


def values(rows: list[tuple]) -> str:
    """Rows as a SQL VALUES list."""
    one = lambda v: f"CAST({v} AS BIGINT)" if isinstance(v, int) else "[" + ", ".join(map(one, v)) + "]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


SQL_DOCS = "docs AS (SELECT doc_id AS doc, source AS work, lang AS kind, substr(text, 1, 24) AS title, concat_ws('/', source, lang, doc_id::VARCHAR) AS file, n_chars AS chars FROM documents)"
SQL_BLOCKS = "blocks AS (SELECT * FROM (SELECT doc, ord, text, length(text) AS len FROM (SELECT doc_id AS doc, unnest(range(len(parts))) AS ord, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))) WHERE text <> '')"
SQL_ENTRIES = """entries AS (SELECT doc_id AS entry_id, doc_id AS doc, regexp_extract(lower(text), '[a-z]{5,}') AS term, text AS body, source AS leaf, lang AS cat,
    'term:' || regexp_extract(lower(text), '[a-z]{5,}') AS group_id, lang AS meaning_id, coalesce(quality, 0) AS definition_quality, coalesce(quality, 0) = 1 AS is_primary,
    doc_id % 97 = 0 AS forced, doc_id % 5 AS version, CASE lang WHEN 'en' THEN 'normal' WHEN 'de' THEN 'special' ELSE 'other' END AS bucket, doc_id AS card_id FROM documents LEFT JOIN labels USING (doc_id) WHERE regexp_extract(lower(text), '[a-z]{5,}') <> '')"""
SQL_TOKENS = "tokens AS (SELECT doc, ord, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM blocks)"
SQL_TERMS = f"terms AS (SELECT query_id, term FROM {values(TERMS)} v(query_id, term))"
SQL_WORDS = "words AS (SELECT query_id, term FROM terms WHERE term NOT LIKE '% %')"
SQL_GROUPS = f"grp AS (SELECT query_id, g, term FROM {values(GROUPS)} v(query_id, g, term))"
SQL_ALIASES = f"aliases AS (SELECT * FROM {values(ALIASES)} v(nick, targets, priority))"
SQL_ASKED = f"asked AS (SELECT * FROM {values(ASKED)} v(query_id, q))"
SQL_LONG_WORDS = "long_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{5,}') AS ws FROM documents)"
SQL_WORD_ALIASES = "aliases AS (SELECT ws[1] AS nick, list(DISTINCT ws[2] ORDER BY ws[2]) AS targets, min(doc_id) AS priority FROM long_words WHERE len(ws) >= 2 AND ws[1] <> ws[2] GROUP BY 1)"
SQL_WORD_QUERIES = "asked AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN upper(ws[doc_id % 3 + 1]) ELSE ws[doc_id % 3 + 1] END AS q FROM long_words WHERE len(ws) >= 3)"
SQL_WORD_REWRITES = "rewrites AS (SELECT substr(t, 1, 4) AS phrase, row_number() OVER (ORDER BY n DESC, t) AS ord, t || 's' AS target FROM (SELECT ws[1] AS t, count(*) AS n FROM long_words WHERE len(ws) >= 1 GROUP BY 1 ORDER BY n DESC, t LIMIT 20))"
SQL_WORD_CONCEPTS = "concepts AS (SELECT DISTINCT ws[1] AS term, substr(ws[1], 1, 6) AS concept_id FROM long_words WHERE len(ws) >= 1)"
SQL_CHAPTERS = "chapters AS (SELECT doc, ord AS start, substr(text, 1, 20) AS title FROM blocks WHERE ord % 10 = 0)"
SQL_LOCATED = "located AS (SELECT *, CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'upper' ELSE 'other' END AS path FROM blocks)"
SQL_HEADED = "headed AS (SELECT doc, ord, CASE WHEN ord % 3 = 0 THEN 'Act ' ELSE '' END || substr(text, 1, 14) AS text FROM blocks)"
SQL_SPOKEN = "spoken AS (SELECT conv_id AS doc, turn AS ord, role || ': ' || text AS text FROM conversations)"
SQL_PAGE_LINES = "page_lines AS (SELECT page_id AS doc, unnest(range(len(p))) AS ord, unnest(p) AS text FROM (SELECT page_id, string_split(regexp_replace(html, '<([hp])', chr(1) || '<\\1', 'g'), chr(1)) AS p FROM pages))"
SQL_CHAPTER_ROWS = "story AS (SELECT r_name AS work, n_name AS route, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS grp, c_custkey AS doc, c_name AS title, r_name = 'ASIA' AS official, c_acctbal > 0 AS two, n_nationkey AS route_ord FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SQL_QA = "qa AS (SELECT conv_id, turn, text AS q, a FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"


def sql(*ctes: str, select: str) -> str:
    """A statement from common table expressions and a select."""
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select
