"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents form an endless stream of words: shuffled, laid end to end, and cut into
blocks of equal size, lap after lap. A source gets as many slots as its target needs blocks, and the
sources' slots lie end to end on a line of 2^K places. Place ``i`` is played at time ``bitreverse(i)``:
the van der Corput point of a time, mapped through the cumulative slot counts, tells the source, and
every span of times holds every source in proportion, to a slot or two. The slots of a source are
ranked by time, and slot number r takes block number r of its stream.

Null texts have no words, null sources are one source, repeated and null ids are rows of their own.
Documents without words are in no block and are taken 0 times. An empty table gives no rows. Columns
other than the three that are read play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.scratch import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
#: Words of a block; weights of the sources in their order, repeating; share of all words that the
#: mix takes; times that a source is taken at most.
BLOCK, WEIGHTS, SHARE, MOST_LAPS = 1024, (5, 2, 1), 1.5, 2
#: Rows that are numbered in one group; copies of a source's row that its documents are dealt over.
CHUNK, SALT = 1 << 16, 16


def before(rows: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, name: str, number: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all earlier rows of their keys, and ``number``, their place in their chunk.

    Rows are ordered by ``chunk``, then ``order``. Sums run inside chunks, and chunks are shifted by
    the sums of those before them, so a key with very many rows is split over tasks.
    """
    at = [*keys, chunk]
    sums = rows.groupBy(*at).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.withColumn("_shift", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*at).orderBy(*order)
    d = rows.withColumn("_own", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(number, F.row_number().over(inside))
    return d.join(shift, at).withColumn(name, (F.col("_own") + F.col("_shift")).cast("long")).drop("_own", "_shift")


def _numbered_sources(base: DataFrame) -> DataFrame:
    """``(source, source_size, source_no)``: sources in code point order, null last, from 0."""
    sizes = base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("rows"))
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sizes.withColumn("_null", F.col("source").isNull()).repartitionByRange(n, "_null", "source").withColumn("_range", F.spark_partition_id())
    d = materialize(ranged.withColumns({"_one": F.lit(1), "_all": F.lit(0)}), "sources")
    return before(d, ["_all"], "_range", ["_null", "source"], "_one", "source_no", "_n").select("source", "source_size", "source_no")


def _with_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most_laps: int) -> DataFrame:
    """``sources`` with ``weight`` and ``target``: shares by weight, stopped at ``most_laps`` sizes, the excess shared again until none is above."""
    d = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)).cast("int")))
    most = (most_laps * F.col("source_size")).cast("double")
    total = float(d.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > most
        x = d.agg(F.sum(F.when(above, 1).otherwise(0)), F.sum(F.when(above, most).otherwise(0.0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if x[0] == stopped or not x[2]:
            break
        stopped, level = x[0], (total - x[1]) / x[2]
    return d.withColumn("target", F.when(F.col("weight") * F.lit(level) > most, most).otherwise(F.col("weight") * F.lit(level)))


def reversed_bits(i: Column, bits: int) -> Column:
    """The integer whose ``bits`` binary digits are those of ``i`` in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(slot, source_no, lap, block, start, words)``: the blocks of the mix in the order of ``slot``.

    ``sources(source_no, source_size, target)``. Slots are times of the van der Corput sequence; they
    have gaps, as there are up to twice as many times as blocks. ``start`` is the block's first word
    in its lap. Blocks at the end of a lap or of a target are shorter.
    """
    d = sources.withColumns({"want": F.floor("target").cast("long"), "per_lap": F.ceil(F.col("source_size") / block).cast("long")}).where("source_size > 0 and want > 0")
    d = d.withColumn("slots", F.expr(f"(want div source_size) * per_lap + cast(ceil((want % source_size) / {block}) as long)"))
    d = materialize(d.withColumns({"_all": F.lit(0), "_part": F.expr(f"source_no div {CHUNK}")}), "slots")
    total = d.agg(F.sum("slots")).first()[0] or 0
    bits = max(0, int(total) - 1).bit_length()
    d = before(d, ["_all"], "_part", ["source_no"], "slots", "place", "_n")
    # A source's places are cut where blocks of places end, so that no task unfolds a whole source.
    cut = d.withColumn("_cut", F.explode(F.expr(f"sequence(place div {CHUNK}, (place + slots - 1) div {CHUNK})"))).repartition("source_no", "_cut")
    places = cut.withColumn("i", F.explode(F.expr(f"sequence(greatest(place, _cut * {CHUNK}), least(place + slots, (_cut + 1) * {CHUNK}) - 1)")))
    times = places.select("source_no", "source_size", "want", "per_lap", reversed_bits(F.col("i"), bits).alias("slot")).withColumns({"_time": F.expr(f"slot div {CHUNK}"), "_one": F.lit(1)})
    ranked = before(times, ["source_no"], "_time", ["slot"], "_one", "rank", "_n")
    ranked = ranked.withColumns({"lap": F.expr("rank div per_lap"), "block": F.expr("rank % per_lap")}).withColumn("start", F.col("block") * block)
    words = F.least(F.lit(block), F.col("source_size") - F.col("start"), F.col("want") - F.col("lap") * F.col("source_size") - F.col("start"))
    return ranked.select("slot", "source_no", "lap", "block", "start", words.alias("words"))


def laid_out(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_laps: int = MOST_LAPS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Documents in their sources' streams, and the sources.

    Documents ``(doc_id, size, source, source_no, source_size, target, chunk, number, first)``: one row
    each, told apart by source_no, chunk and number; ``first`` is the place of its first word in a lap.
    The order inside a source is that of the md5 of seed and id, then id and size.
    """
    base = materialize(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = materialize(_with_targets(_numbered_sources(base), weights, share, most_laps), "targets")
    chunks = max(1, -(-base.count() // CHUNK))
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("_source", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    key = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8"))
    d = base.withColumn("_key", key).withColumn("_hash", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"))
    d = d.withColumns({"_salt": (F.col("_hash") % SALT).cast("int"), "chunk": F.expr(f"(_hash * {chunks}) div {1 << 32}"), "_source": F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))})
    d = d.join(salted.drop("source"), ["_source", "_salt"]).drop("_source", "_salt", "_hash")
    placed = before(d, ["source_no"], "chunk", ["_key", "doc_id", "size"], "size", "first", "number")
    return placed.select("doc_id", "size", "source", "source_no", "source_size", "target", "chunk", "number", "first"), sources


def mix(placed: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: every document with the pieces of it that the schedule takes.

    All columns of ``placed`` with ``slot``, ``lap``, ``start`` (the piece's first word in the
    document) and ``length`` (words); a document that no slot takes has one row with null pieces.
    """
    held = F.when(F.col("size") > 0, F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}")))
    cut = placed.withColumn("block", F.explode_outer(held))
    taken = schedule(sources, block).withColumnRenamed("start", "_start")
    both = cut.join(taken, ["source_no", "block"], "left")
    head, tail = F.greatest(F.col("first"), F.col("_start")), F.least(F.col("first") + F.col("size"), F.col("_start") + F.col("words"))
    pieces = both.withColumns({"start": head - F.col("first"), "length": tail - head})
    some = F.col("slot").isNotNull() & (F.col("length") > 0)  # a shorter last block may end before the document begins
    return pieces.withColumns({c: F.when(some, F.col(c)) for c in ("slot", "lap", "start", "length")}).drop("_start", "words", "block")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, pieces)`` of every document: the words of it that the mix takes, repeats counted."""
    placed, sources = laid_out(docs, **options)
    pieces = mix(placed, sources, options.get("block", BLOCK))
    keys = ["source_no", "chunk", "number", "doc_id", "size", "source_size", "target"]
    each = pieces.groupBy(*keys).agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("taken"), F.count("length").alias("pieces"))
    return each.select("doc_id", "size", "source_size", "target", "taken", "pieces")
