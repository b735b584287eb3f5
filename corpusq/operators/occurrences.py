"""Occurrences of many terms in many blocks, their statistics and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.functions.positions import match_positions
from corpusq.operators.ordering import numbered
from corpusq.sources.storage import checkpointed

#: Terms up to which every block is tested for all of them in one scan.
FEW_TERMS = 200
#: Grams of terms up to which they are sent to every task that makes grams of blocks.
SENT_GRAMS = 100_000
#: Scans of the blocks up to which terms are sent to them, at most SENT_GRAMS grams a scan.
MOST_SCANS = 32
#: Passages and hits that a listing keeps; all are counted.
MOST_PASSAGES, MOST_HITS = 20_000, 200_000
#: Words of a chain up to which two words that follow each other are looked up together.
PAIRED = 6
GAP = f"[{tx.MIDDLE_DOTS}\\s]+"


def term_regex(term: Column) -> Column:
    """The pattern of a term, without regard to case."""
    return F.concat(F.lit("(?iu)"), tx.term_pattern(term))


def _piece(term: Column) -> Column:
    """The longest piece of a term between dots and spaces, which every match holds as it stands."""
    pieces = F.regexp_extract_all(F.lower(term), F.lit(f"[^{tx.MIDDLE_DOTS}\\s]+"), F.lit(0))
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("size"), p.alias("piece"))))
    return F.coalesce(longest.piece, F.lit(""))


def scan_occurrences(terms: DataFrame, blocks: DataFrame, positions: bool = True) -> DataFrame:
    """``(query_id, term, doc, ord, n[, positions])`` by testing every block for every term in one scan.

    For at most FEW_TERMS rows of terms, which is checked; they become literal patterns, compiled
    once. A block that lacks a term's longest piece is not searched for it.
    """
    few = terms.select("term", term_regex(F.col("term")).alias("regex"), _piece(F.col("term")).alias("piece")).where("piece <> ''").limit(FEW_TERMS + 1).collect()
    if len(few) > FEW_TERMS:
        raise ValueError(f"over {FEW_TERMS} terms: use index_occurrences")
    text, low = F.col("text"), F.lower("text")
    kinds = "array<struct<term:string,n:bigint>>"
    cells = []
    for term, (regex, piece) in {r.term: (r.regex, r.piece) for r in few}.items():
        found = F.struct(F.lit(term).alias("term"), F.regexp_count(text, F.lit(regex)).cast("long").alias("n"))
        cells.append(F.when(F.contains(low, F.lit(piece)), found))
    held = F.filter(F.array(*cells), lambda x: x.n > 0) if cells else F.expr(f"cast(array() as {kinds})")
    keep = ["doc", "ord", *(["text"] if positions else [])]
    hits = blocks.select(*keep, F.explode(held).alias("x")).select(*keep, "x.term", "x.n")
    hits = hits.join(F.broadcast(terms.select("query_id", "term", term_regex(F.col("term")).alias("_regex")).distinct()), "term")  # FEW_TERMS rows at most
    out = ["query_id", "term", "doc", "ord", "n"]
    return hits.select(*out, match_positions(text, F.col("_regex")).alias("positions")) if positions else hits.select(*out)


def _singles_and_pairs(runs: Column) -> Column:
    """All characters of some runs, and all pairs of neighbours."""
    def of(run: Column) -> Column:
        chars = F.filter(F.split(run, ""), lambda c: c != "")
        return tx.let(chars, lambda cs: F.concat(cs, F.zip_with(F.slice(cs, 1, F.greatest(F.lit(0), F.size(cs) - 1)), F.slice(cs, 2, F.greatest(F.lit(0), F.size(cs) - 1)), lambda a, b: F.concat(a, b))))

    return F.flatten(F.transform(runs, of))


def block_grams(blocks: DataFrame, follow: bool = False, others: bool = True) -> DataFrame:
    """``(gram, doc, ord)``: lower-case Latin words; with ``others`` single characters and pairs of digits and of all else; with ``follow`` also words that follow each other."""
    low = F.lower("text")
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    rest = F.regexp_extract_all(low, F.lit("[0-9]+|[^a-z0-9\\s]+"), F.lit(0))
    if follow:
        words = tx.let(words, lambda ws: F.concat(ws, F.zip_with(F.slice(ws, 1, F.greatest(F.lit(0), F.size(ws) - 1)), F.slice(ws, 2, F.greatest(F.lit(0), F.size(ws) - 1)), lambda a, b: F.concat(a, F.lit(" "), b))))
    return blocks.select(F.explode(F.array_distinct(F.concat(words, _singles_and_pairs(rest)) if others else words)).alias("gram"), "doc", "ord")


def term_anchors(terms: DataFrame, follow: bool = False) -> DataFrame:
    """``(query_id, term, anchor, gram)``: of every anchor, a block that holds the term has one of the grams.

    Dots and spaces of a term may be missing from a match. In a Latin term, words that only such
    gaps divide are one word of the block if the gaps are closed, so a chain of them has an anchor with
    the alternatives first word, first two joined, and so on. With ``follow``, for ``block_grams`` that
    have them, a chain of at most PAIRED words is told by what its first two words in the block can be:
    a frequent first word alone would bring every term that begins with it to every block that holds
    it. Elsewhere characters and pairs between two gaps stand as they are, and each is an anchor of its own.
    """
    low = F.lower(F.trim("term"))
    chains = F.regexp_extract_all(low, F.lit(f"[a-z0-9]+(?:{GAP}[a-z0-9]+)*"), F.lit(0))
    starts = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws)), lambda n: F.array_join(F.slice(ws, F.lit(1), n), ""))
    # The first word of the block is the chain's first n words, the next one is some m of those that are left, if any.
    after = lambda ws, n: F.transform(F.sequence(F.lit(1), F.size(ws) - n), lambda m: F.concat(F.array_join(F.slice(ws, F.lit(1), n), ""), F.lit(" "), F.array_join(F.slice(ws, n + 1, m), "")))
    twos = lambda ws: F.flatten(F.transform(F.sequence(F.lit(1), F.size(ws)), lambda n: F.when(n == F.size(ws), F.array(F.array_join(ws, ""))).otherwise(after(ws, n))))
    joined = F.transform(chains, lambda c: tx.let(F.split(c, GAP, -1), lambda ws: F.when(F.size(ws) <= PAIRED, twos(ws)).otherwise(starts(ws)) if follow else starts(ws)))
    rest = _singles_and_pairs(F.regexp_extract_all(low, F.lit(f"[0-9]+|[^a-z0-9\\s{tx.MIDDLE_DOTS}]+"), F.lit(0)))
    anchors = F.when(tx.is_latin(F.col("term")), joined).otherwise(F.transform(F.array_distinct(rest), lambda g: F.array(g)))
    each = terms.select("query_id", "term", F.posexplode(anchors).alias("anchor", "grams"))
    return each.select("query_id", "term", "anchor", F.explode(F.array_distinct("grams")).alias("gram"))


def near_blocks(terms: DataFrame, blocks: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """``(query_id, term, doc, ord)``: the blocks that hold a gram of each term's rarest anchor; no match lies elsewhere."""
    anchors = checkpointed(term_anchors(terms.select("query_id", "term").distinct(), grams is None))
    asked = anchors.select("gram").distinct()
    # Few grams are sent to the blocks, so that the blocks' own grams, many times as many, are not shuffled; kinds of grams that no term asks for are not made.
    kinds = asked.agg(F.count("*").alias("n"), F.max(F.contains("gram", F.lit(" "))).alias("follow"), F.max(~F.col("gram").rlike("[a-z]")).alias("others")).first()
    grams = block_grams(blocks, bool(kinds.follow), bool(kinds.others)) if grams is None else grams
    held = checkpointed(grams.join(F.broadcast(asked) if kinds.n <= SENT_GRAMS else asked, "gram"))
    frequency = held.groupBy("gram").agg(F.count("*").alias("df"))
    cost = anchors.join(frequency, "gram", "left").groupBy("query_id", "term", "anchor").agg(F.sum(F.coalesce("df", F.lit(0))).alias("cost"))
    rarest = cost.groupBy("query_id", "term").agg(F.min(F.struct("cost", "anchor")).alias("x")).where("x.cost > 0").select("query_id", "term", F.col("x.anchor").alias("anchor"))
    wanted = rarest.join(anchors, ["query_id", "term", "anchor"]).select("query_id", "term", "gram")
    return held.join(wanted, "gram").select("query_id", "term", "doc", "ord").distinct()


def sent_occurrences(anchors: DataFrame, patterns: DataFrame, blocks: DataFrame, scans: int) -> DataFrame:
    """``(query_id, term, doc, ord, text, _regex, n)``: blocks looked up in the grams of terms of one anchor, and counted where they lie.

    The terms are sent in ``scans`` shares, one scan of the blocks for each, so that neither blocks nor
    hits are shuffled. A block that has several grams of a term is counted for the first of them.
    """
    grams = F.array_sort(F.collect_list("gram"))
    known = anchors.groupBy("query_id", "term").agg(grams.alias("_grams")).join(patterns, "term").withColumn("gram", F.explode("_grams"))
    before = F.filter("_grams", lambda g: g < F.col("gram"))
    known = known.select("gram", "query_id", "term", "_regex", "_piece", before.alias("_before"), F.pmod(F.xxhash64("term"), F.lit(scans)).alias("_scan"))
    low = F.lower("text")
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    held = tx.let(words, lambda ws: F.array_distinct(F.concat(ws, F.zip_with(F.slice(ws, 1, F.greatest(F.lit(0), F.size(ws) - 1)), F.slice(ws, 2, F.greatest(F.lit(0), F.size(ws) - 1)), lambda a, b: F.concat(a, F.lit(" "), b)))))
    count = F.filter(F.array(F.regexp_count("text", F.col("_regex")).cast("long")), lambda n: n > 0)  # counted once, though it is tested and kept
    parts = []
    for scan in range(scans):
        share = F.broadcast(known.where(F.col("_scan") == scan).drop("_scan"))
        each = blocks.select("doc", "ord", "text", held.alias("_held")).select("*", F.explode("_held").alias("gram")).join(share, "gram")
        near = each.where(~F.arrays_overlap("_before", "_held") & F.contains(low, F.col("_piece")))
        parts.append(near.select("query_id", "term", "doc", "ord", "text", "_regex", F.explode(count).alias("n")))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return hits


def index_occurrences(terms: DataFrame, blocks: DataFrame, grams: DataFrame | None = None, positions: bool = True) -> DataFrame:
    """The rows of ``scan_occurrences`` by way of a gram index: each term looks up its rarest anchor, then is verified.

    For any number of terms; ``grams`` is a kept ``block_grams``. Only grams of the terms are counted
    and joined.
    """
    patterns = terms.select("term").distinct().select("term", term_regex(F.col("term")).alias("_regex"), _piece(F.col("term")).alias("_piece"))
    near = near_blocks(terms, blocks, grams).join(patterns, "term").join(blocks.select("doc", "ord", "text"), ["doc", "ord"])
    regex = F.col("_regex")
    count = F.filter(F.array(F.regexp_count("text", regex).cast("long")), lambda n: n > 0)  # counted once, though it is tested and kept
    hits = near.where(F.contains(F.lower("text"), F.col("_piece"))).select("query_id", "term", "doc", "ord", "text", "_regex", F.explode(count).alias("n"))
    out = ["query_id", "term", "doc", "ord", "n"]
    return hits.select(*out, match_positions(F.col("text"), regex).alias("positions")) if positions else hits.select(*out)


def many_occurrences(terms: DataFrame, blocks: DataFrame, positions: bool = True) -> DataFrame:
    """The rows of ``index_occurrences``; terms of one anchor of Latin words are sent to the blocks, as long as MOST_SCANS scans are enough for their grams."""
    terms = checkpointed(terms.select("query_id", "term").distinct())
    anchors = checkpointed(term_anchors(terms, True))
    single = anchors.groupBy("query_id", "term").agg(F.max("anchor").alias("_last"), F.min(F.col("gram").rlike("^[a-z0-9 ]+$")).alias("_words")).where("_last = 0 and _words").select("query_id", "term")
    sent = anchors.join(single, ["query_id", "term"], "left_semi")
    n = sent.count()
    if not 0 < n <= MOST_SCANS * SENT_GRAMS:
        return index_occurrences(terms, blocks, positions=positions)
    patterns = terms.select("term").distinct().select("term", term_regex(F.col("term")).alias("_regex"), _piece(F.col("term")).alias("_piece"))
    hits, out = sent_occurrences(sent, patterns, blocks, -(-n // SENT_GRAMS)), ["query_id", "term", "doc", "ord", "n"]
    hits = hits.select(*out, match_positions(F.col("text"), F.col("_regex")).alias("positions")) if positions else hits.select(*out)
    others = checkpointed(terms.join(single, ["query_id", "term"], "left_anti"))
    return hits if others.isEmpty() else hits.unionByName(index_occurrences(others, blocks, positions=positions))


def occurrences(terms: DataFrame, blocks: DataFrame, positions: bool = True) -> DataFrame:
    """Occurrences by the cheaper of both ways, decided by the number of terms; the rows are the same."""
    few = terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    return (scan_occurrences if few else many_occurrences)(terms, blocks, positions=positions)


def occurrence_stats(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, work, hits, segments, docs)`` by work, and for all works (work null)."""
    per = hits.groupBy("query_id", "doc").agg(F.sum("n").alias("n"), F.count("*").alias("segments")).join(docs.select("doc", "work"), "doc")
    return per.groupingSets([["query_id", "work"], ["query_id"]], "query_id", "work").agg(F.sum("n").alias("hits"), F.sum("segments").alias("segments"), F.count("*").alias("docs"))


def capped(hits: DataFrame, passages: int = MOST_PASSAGES, most: int = MOST_HITS) -> DataFrame:
    """The first passages of each query with ``total``, ``passages`` and ``truncated``.

    All hits are counted; only the listing is bounded, as its feature. The bound is applied inside
    every partition before rows of a query meet.
    """
    totals = hits.groupBy("query_id").agg(F.sum("n").alias("total"), F.count("*").alias("passages"))
    order = Window.partitionBy("query_id").orderBy("doc", "ord")
    first = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= passages)
    first = first.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") - F.col("n") < most)
    return first.drop("rank", "upto").join(totals, "query_id").withColumn("truncated", (F.col("passages") > passages) | (F.col("total") > most))


def diversify(hits: DataFrame, most: int | None = None) -> DataFrame:
    """Hits with ``place`` inside (query, work): by kind, first of each document before repeats, in order.

    With ``most`` only the first places are kept, and are cut inside every partition first.
    """
    in_doc = Window.partitionBy("query_id", "work", "kind_rank", "doc").orderBy("ord")
    d = hits.withColumn("again", (F.row_number().over(in_doc) > 1).cast("int"))
    if most is not None:
        w = Window.partitionBy("query_id", "work").orderBy("kind_rank", "again", "doc", "ord")
        return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("again")
    return numbered(d, ["query_id", "work"], ["kind_rank", "again"], ["doc", "ord"], "place").drop("again")


def round_robin(placed: DataFrame, limit: int, rounds: int = 8) -> DataFrame:
    """One hit of each work in turn, at most ``rounds`` times, until ``limit``: ``pick`` is the order."""
    w = Window.partitionBy("query_id").orderBy("place", "work_rank", "work")
    return placed.where(F.col("place") <= rounds).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= limit)


def listing(hits: DataFrame, docs: DataFrame, work: str | None = None) -> DataFrame:
    """Hits with document attributes, numbered inside each query by kind and place."""
    d = hits.join(docs.select("doc", "work", "kind"), "doc")
    d = d.where(F.col("work") == work) if work else d
    return numbered(d, ["query_id"], ["kind"], ["doc", "ord"], "rank")
