"""One query per training-data operator, each over its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import bloom_dedup, bm25_packing, code_grid, diagonal_license, divergence, filter_audit, nbsvm, ngram_jaccard, randomness, sentencepiece_nbest, source_mix, tag_path, warc


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 4-word shingle sets have Jaccard >= 0.85."""
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of all documents: their scores, sizes and digests."""
    found = sentencepiece_nbest.encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), n=3, with_ids=False)
    each = [F.get(c, F.lit(i)).alias(f"{name}_{i + 1}") for i in range(3) for c, name in (("scores", "score"), ("sizes", "n_pieces"), ("crc32s", "ids_crc32"))]
    return found.select("doc_id", "n_pieces", *each, "round_trip")


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens, neighbours by BM25."""
    return bm25_packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; learnt from labelled rows outside the held-out fifth."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.train(docs, _table(spark, sf_dir, "labels"), ~nbsvm.held_out())
    scored = nbsvm.score(docs, model)
    return scored.select("doc_id", nbsvm.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: base spans by pattern, more by the randomness battery."""
    found = randomness.find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(randomness.spans_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"), randomness.spans_text(F.concat("base", "added")).alias("spans"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return tag_path.main_text(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents, with references of their languages from all documents."""
    return divergence.quality_rules(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return bloom_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template spans of all documents."""
    return diagonal_license.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, normalised to a member per record, and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("html", "url")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all documents, by language, in every order."""
    return filter_audit.audit(filter_audit.failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op12_code_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, their errors, and the digest of the codebooks."""
    codes, books = code_grid.compress(_table(spark, sf_dir, "embeddings"))
    return code_grid.with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(code_grid.codebooks_sha256(books)).alias("codebooks_sha256"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is taken by the mix of all sources."""
    return source_mix.taken_words(_table(spark, sf_dir, "documents")).drop("pieces")


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_bm25_packing": op3_bm25_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_secret_scan": op5_secret_scan,
    "op6_html_text": op6_html_text,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_warc": op10_warc,
    "op11_filter_audit": op11_filter_audit,
    "op12_code_grid": op12_code_grid,
    "op13_source_mix": op13_source_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingle
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b, k = x.n AND k = y.n AS same FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        r AS (SELECT doc_id, doc_id AS via FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.via = e.a)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(via) AS component_id,
               least(w.doc_id, (SELECT min(b) FROM e WHERE a = w.doc_id AND same)) AS class_id
        FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id
    """,
    # The sample's pages hold one article element each, which the operator has to choose by itself.
    "op6_html_text": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
        b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(h, '<br>', ' ', 'g'), '</?(p|h1)>', chr(1), 'g'), '(?s)<[^>]*>', '', 'g'), chr(1)) AS parts FROM a),
        c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS blocks FROM b)
        SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10))) AS n_chars FROM c
    """,
    "op7_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents),
        w AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
        g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS five FROM w WHERE len(ws) >= 5),
        again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
        base AS (
            SELECT doc_id, lang, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
                   coalesce(rep.n, 0) AS n_repeat_words,
                   [length(regexp_replace(text, '[^A-Z]', '', 'g')), length(regexp_replace(text, '[^a-z\x00-\x08\x0E-\x1F\x7F]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')),
                    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), length(regexp_replace(text, '[^!"''()+,\-./:;=?@\[\\\]^_`{}~]', '', 'g')), length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))] AS c
            FROM w LEFT JOIN rep USING (doc_id)),
        classes AS (SELECT lang, [sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4]), sum(c[5]), sum(c[6]), sum(c[7])] AS q FROM base GROUP BY lang),
        tokens AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS t FROM d),
        freq AS (SELECT lang, t, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS total FROM tokens GROUP BY lang, t),
        common AS (SELECT * FROM freq QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, t) <= 24),
        own AS (SELECT doc_id, t, count(*) AS k FROM tokens SEMI JOIN common USING (lang, t) GROUP BY doc_id, t),
        pairs AS (
            SELECT doc_id, coalesce(k, 0) / n_words AS p, n / total AS q FROM base JOIN common USING (lang) LEFT JOIN own USING (doc_id, t) WHERE n_words > 0
            UNION ALL SELECT doc_id, 1 - coalesce(any_value(held.k), 0) / any_value(n_words), 1 - sum(n) / any_value(total) FROM base JOIN common USING (lang) LEFT JOIN (SELECT doc_id, sum(k) AS k FROM own GROUP BY doc_id) held USING (doc_id) WHERE n_words > 0 GROUP BY doc_id),
        words AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS far, count(*) - 1 AS cells FROM pairs GROUP BY doc_id),
        cp AS (SELECT doc_id, unnest(c) / list_sum(c) AS p, unnest(q) / list_sum(q) AS q FROM base JOIN classes USING (lang) WHERE list_sum(c) > 0),
        chars AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS far FROM cp GROUP BY doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (n_words < 50 OR (coalesce(chars.far, 0) <= 0.25 + 0.4 / sqrt(greatest(n_words, 1))
                   AND coalesce(words.far, 0) <= greatest(0.30, sqrt((greatest(cells, 1) + 4 * sqrt(2 * greatest(cells, 1))) / (8 * ln(2) * greatest(n_words, 1)))))) AS kept
        FROM base LEFT JOIN chars USING (doc_id) LEFT JOIN words USING (doc_id)
    """,
    "op10_warc": r"""
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        k AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
    """,
    "op11_filter_audit": r"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        d AS (
            SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
                   regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
                   doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS bad
            FROM w),
        f AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
                     count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM d GROUP BY ALL),
        o(o) AS (SELECT '' UNION ALL SELECT o || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(x) WHERE NOT contains(o, x)),
        s AS (SELECT o AS filter_order, step, substr(o, step, 1) AS own, substr(o, 1, step - 1) AS earlier FROM o, (VALUES (1), (2), (3), (4), (5)) s(step) WHERE length(o) = 5),
        m AS (
            SELECT part, filter_order, step, own,
                   CAST(sum(n) FILTER (translate(fails, earlier || own, '') = fails) AS BIGINT) AS kept,
                   CAST(sum(n) FILTER (contains(fails, own) AND translate(fails, earlier, '') = fails) AS BIGINT) AS removed,
                   CAST(sum(n) FILTER (contains(fails, own) AND translate(fails, earlier, '') <> fails) AS BIGINT) AS redundant,
                   CAST(sum(n) FILTER (fails = own) AS BIGINT) AS unique_fails,
                   CAST(sum(good) FILTER (contains(fails, own) AND translate(fails, earlier, '') = fails) AS BIGINT) AS good_lost,
                   CAST(sum(bad) FILTER (contains(fails, own) AND translate(fails, earlier, '') = fails) AS BIGINT) AS toxic_lost
            FROM f, s GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
               coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
        FROM m
    """,
    "op12_code_grid": r"""
        WITH RECURSIVE kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) r(p)),
        rounds AS (
            SELECT 0 AS round, p, k, x AS e FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS k FROM parts) WHERE k < 256
            UNION ALL
            (WITH near AS (
                SELECT any_value(r.round) AS round, parts.p, parts.vec_id, any_value(x) AS x,
                       arg_min(r.k, list_sum(list_transform(list_zip(x, r.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + r.k) AS k
                FROM parts JOIN rounds r ON r.p = parts.p WHERE r.round < 4 GROUP BY parts.p, parts.vec_id),
             means AS (
                SELECT p, k, list(m ORDER BY i) AS e FROM (
                    SELECT p, k, i, CAST(sum(c) - ((sum(c) % count(*)) + count(*)) % count(*) AS BIGINT) // count(*) AS m
                    FROM (SELECT p, k, unnest(x) AS c, unnest(range(len(x))) AS i FROM near) GROUP BY p, k, i) GROUP BY p, k)
             SELECT r.round + 1, r.p, r.k, coalesce(means.e, r.e) FROM rounds r LEFT JOIN means USING (p, k) WHERE r.round < 4)),
        book AS (SELECT p, k, e FROM rounds WHERE round = 4),
        found AS (
            SELECT vec_id, any_value(label) AS label, p, min(CAST(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 256 + k) AS best
            FROM parts JOIN book USING (p) GROUP BY vec_id, p),
        codes AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM found GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) FROM book) AS codebooks_sha256
        FROM codes
    """,
    # The order inside a source is the operator's (md5 of seed and id); the rest is closed arithmetic without slots or blocks.
    "op13_source_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
        r AS (SELECT *, 2 * source_size / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS whole FROM s),
        -- Sources stop in the order of size to weight: the level if exactly those before this one have stopped.
        l AS (SELECT *, (whole - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
        t AS (SELECT source, source_size, CASE WHEN stop.level IS NULL OR weight * stop.level > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE weight * stop.level END AS target
              FROM l, (SELECT arg_min(level, ratio) AS level FROM l WHERE weight * level <= 2 * source_size) stop),
        p AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS want,
                     CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5('0:' || doc_id), doc_id, size) - size AS BIGINT) AS first
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CASE WHEN size = 0 THEN 0 ELSE (want // source_size) * size + greatest(0, least(first + size, want % source_size) - first) END AS taken
        FROM p
    """,
}
