"""Aliases, rewrites and the resolution of query tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.sources.storage import bounded, checkpointed, stored

#: Rows of one key that a join leaves together.
DEALT = 1000


def load_aliases(raw: DataFrame) -> DataFrame:
    """``(nick, targets, priority)`` of ``raw(source, json)``.

    A value may be a string or a list; the first source that names a nick wins; targets equal to
    the nick are dropped, and so is a nick without any other.
    """
    pairs = raw.select("source", F.explode(F.from_json("json", "map<string,string>")).alias("nick", "value"))
    many = F.from_json("value", "array<string>")
    pairs = pairs.withColumn("targets", F.when(F.startswith(F.ltrim("value"), F.lit("[")), many).otherwise(F.array("value")))
    pairs = pairs.withColumn("targets", F.filter("targets", lambda t: (t != "") & (t != F.col("nick")))).where(F.size("targets") > 0)
    w = Window.partitionBy("nick").orderBy("source")
    return pairs.withColumn("priority", F.row_number().over(w)).where("priority = 1").select("nick", "targets", F.col("source").alias("priority"))


def dealt_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``rows`` joined with a table of one row per ``key``; a key of over DEALT rows is dealt over several tasks, as each may lengthen its rows much; ``by`` tells the rows of a key apart."""
    counts = rows.groupBy(key).agg(F.ceil(F.count("*") / DEALT).cast("int").alias("_parts"))
    frequent = counts.where(F.col("_parts") > 1)
    parts = F.coalesce("_parts", F.lit(1))
    sides = table.join(frequent, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return rows.join(frequent, key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts").join(sides, [key, "_part"], how).drop("_part")


def best_alias(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(q, best)``: priority and nick of the best alias of every distinct query; targets stay out of it, for a nick may have very many."""
    own = aliases.select(F.col("nick").alias("word"), F.lit(2).alias("way"), "priority", "nick")
    back = aliases.select(F.explode("targets").alias("word"), F.lit(0).alias("way"), "priority", "nick")
    of = own.unionByName(back).groupBy("word", "way").agg(F.min(F.struct("priority", "nick")).alias("x"))
    found = queries.select("q", F.lower("q").alias("k")).distinct().join(of.withColumn("k", F.lower("word")), "k")
    rank = F.struct((F.col("way") + F.when(F.col("word") == F.col("q"), 0).otherwise(1)).alias("way"), "x")
    return found.groupBy("q").agg(F.min(rank).alias("r")).select("q", F.col("r.x").alias("best"))


def _targets(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy(F.struct("priority", "nick").alias("best")).agg(F.min("targets").alias("targets"))


def _canonical(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Queries with ``best`` and ``canonical``: the only target of the best alias, else the query."""
    only = _targets(aliases).where("size(targets) = 1").select("best", F.get("targets", F.lit(0)).alias("_only"))
    d = queries.join(best_alias(queries, aliases), "q", "left").join(only, "best", "left")
    return d.select(*queries.columns, "best", F.coalesce("_only", "q").alias("canonical"))


def resolve_alias(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Queries with ``nick`` and ``targets`` of the best alias.

    Order: a target equal to the query, one equal but for case, a nick equal, a nick equal but for
    case; then the alias's priority. Queries without an alias have nulls.
    """
    queries, aliases = checkpointed(queries), checkpointed(aliases)
    best = queries.join(best_alias(queries, aliases), "q", "left")
    return dealt_join(best, _targets(aliases), "best").select(*queries.columns, "best.nick", "targets")


def apply_alias(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Queries with ``text`` and ``note``: replaced where an alias of the whole query has one target."""
    queries, aliases = checkpointed(queries), checkpointed(aliases)
    r = _canonical(queries, aliases)
    return r.select(*queries.columns, F.col("canonical").alias("text"), F.when(F.col("canonical") != F.col("q"), F.concat("best.nick", F.lit("→"), "canonical")).alias("note"))


def rewrite_parts(queries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """``(query_id, target, ord)``: targets of every phrase that the query contains, each once.

    ``rewrites(phrase, ord, targets)`` is a small curated table, which is checked.
    """
    hit = queries.join(bounded(rewrites, "rewrites"), F.contains(queries["q"], rewrites["phrase"])).select("query_id", "ord", F.posexplode("targets").alias("at", "target"))
    first = hit.groupBy("query_id", "target").agg(F.min(F.struct("ord", "at")).alias("o"))
    return first.select("query_id", "target", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "target")).alias("ord"))


def _variants(own: list[Column], targets: Column, others: Column) -> Column:
    """``ord``, ``term`` and ``branch`` of the words of one query; equal words but for case count once, the first."""
    every = [F.transform(F.array(*own), lambda t, i: F.struct(i.alias("branch"), t.alias("term"))), F.transform(targets, lambda t: F.struct(F.lit(2).alias("branch"), t.alias("term"))), others]
    every = F.concat(*(F.coalesce(x, F.expr("cast(array() as array<struct<branch:int,term:string>>)")) for x in every))
    keyed = F.array_sort(F.transform(F.filter(every, lambda x: F.trim(x.term) != ""), lambda x: F.struct(F.lower(x.term).alias("k"), x.branch.alias("branch"), x.term.alias("term"))))
    firsts = tx.let(keyed, lambda s: F.filter(s, lambda x, n: (n == 0) | (F.get(s, n - 1).k != x.k)))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x.branch.alias("branch"), x.term.alias("term")))), lambda x, i: F.struct((i + 1).alias("ord"), x.term.alias("term"), x.branch.alias("branch")))


def word_variants(queries: DataFrame, aliases: DataFrame, entries: DataFrame, rewrites: DataFrame, specific: int = 2) -> DataFrame:
    """``(q, canonical, best, members, variants)``: the words of ``expand_terms``, once for every distinct query, or for every DEALT of equal ones.

    ``members`` are the rows of ``queries`` without ``q``. A nick's targets, by far the most of the
    words, are joined last, as they stand in its alias: the words of a query are put together where
    they are used, and are not sent on.
    """
    words = queries.select(F.col("q").alias("query_id"), "q").distinct()
    r = checkpointed(_canonical(words, aliases))
    concept = entries.where("concept_id is not null").select(F.lower("term").alias("k"), "concept_id").distinct()
    same = entries.where("concept_id is not null").select("concept_id", "term").distinct()
    peers = r.select("query_id", F.lower("canonical").alias("k")).join(concept, "k").join(same, "concept_id").select("query_id", F.lit(4).alias("branch"), "term")
    nicks = aliases.select("nick", F.explode("targets").alias("target"))
    reverse = r.join(nicks.withColumnRenamed("nick", "other"), F.lower("canonical") == F.lower("target")).where((F.length("other") >= specific) & ~F.contains(F.lower("canonical"), F.lower("other")))
    every = rewrite_parts(words, rewrites).select("query_id", F.lit(3).alias("branch"), F.col("target").alias("term")).unionByName(peers)
    every = every.unionByName(reverse.select("query_id", F.lit(5).alias("branch"), F.col("other").alias("term")))
    others = every.groupBy(F.col("query_id").alias("q")).agg(F.collect_list(F.struct("branch", "term")).alias("others"))
    frequent = queries.groupBy("q").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("_parts")).where(F.col("_parts") > 1)
    chunk = F.pmod(F.xxhash64("query_id"), F.coalesce("_parts", F.lit(1))).alias("_chunk")
    members = queries.join(frequent, "q", "left").groupBy("q", chunk).agg(F.collect_list(F.struct(*(c for c in queries.columns if c != "q"))).alias("members"))
    d = stored(members.join(r.drop("query_id").join(others, "q", "left"), "q"))
    d = dealt_join(d, _targets(aliases), "best", "left", ("q", "_chunk"))
    return d.select("q", "canonical", "best", "members", _variants([F.col("q"), F.col("canonical")], F.col("targets"), F.col("others")).alias("variants"))


def expand_terms(queries: DataFrame, aliases: DataFrame, entries: DataFrame, rewrites: DataFrame, specific: int = 2) -> DataFrame:
    """``(query_id, term, ord, branch)``: the words under which each query is searched.

    In order: the query, its canonical form, alias targets, rewrite targets, terms of the same
    concept, and nicks of the canonical form that are long enough to be specific. Equal terms but
    for case count once. ``entries(term, concept_id)``. Equal queries are expanded once.
    """
    queries, aliases = checkpointed(queries.select("query_id", "q")), checkpointed(aliases)
    d = word_variants(queries, aliases, entries, rewrites, specific).select(F.explode("members").alias("m"), "variants")
    return d.select("m.query_id", F.explode("variants").alias("x")).select("query_id", "x.term", "x.ord", "x.branch")


def term_groups(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(query_id, group, term, canonical)`` of the queries with two or more distinct parts."""
    parts = queries.select("query_id", F.posexplode(tx.split_terms(F.col("q"))).alias("place", "part"))
    keyed = checkpointed(parts.select("query_id", "place", F.col("part").alias("q")))
    r = _canonical(keyed, checkpointed(aliases)).select("query_id", "place", F.col("q").alias("term"), "canonical")
    first = r.groupBy("query_id", tx.match_key(F.col("canonical")).alias("k")).agg(F.min(F.struct("place", "term", "canonical")).alias("x"))
    w = Window.partitionBy("query_id")
    g = first.select("query_id", (F.row_number().over(w.orderBy("x.place")) - 1).alias("group"), "x.term", "x.canonical", F.count("*").over(w).alias("groups"))
    return g.where("groups >= 2").drop("groups")


def resolve(queries: DataFrame, aliases: DataFrame, entries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Queries with requested and canonical form, notes and the ordered variants."""
    n = queries.withColumn("n", tx.normalize_query_text(F.trim("q")))
    n = checkpointed(n.select("query_id", F.col("n.text").alias("q"), F.col("n.notes").alias("notes")))
    aliases = checkpointed(aliases)
    d = word_variants(n, aliases, entries, rewrites).where("size(variants) > 0").select(F.explode("members").alias("m"), F.col("q").alias("requested"), "canonical", "best", F.transform("variants", lambda x: x.term).alias("variants"))
    note = F.when(F.col("canonical") != F.col("requested"), F.concat("best.nick", F.lit("→"), "canonical"))
    return d.select("m.query_id", "requested", "canonical", F.array_compact(F.concat("m.notes", F.array(note))).alias("notes"), "variants")
