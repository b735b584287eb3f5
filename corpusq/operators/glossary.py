"""Glossary cards: ranking, grouping, near duplicates, coverage, listing."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.functions import text as tx
from corpusq.functions.grams import TILE, Grams, shared, trigrams
from corpusq.functions.matching import Shelf, Text
from corpusq.operators.suffixes import names_with
from corpusq.sources.storage import checkpointed, stored

#: Cards and characters of a group whose n-grams are compared in one task.
DEALT, DEALT_TEXT = 1024, 1 << 22
#: Cards and characters of a group that are compared by matching blocks in one task.
DEALT_CARDS, DEALT_CHARS = 256, 1 << 19
#: Blocks of a group, unless they have more characters than a task takes; characters that a card's fixed work stands for.
MOST_BLOCKS, MOST_CHARS, CARD_WORK = 16, 1 << 24, 500
#: Groups of over one block up to which their blocks' sizes are sent to every task that deals cards.
SENT_GROUPS = 20_000
#: Partitions of block pairs for each partition of a shuffle: they differ much in work, little in bytes.
BLOCK_PAIR_SPREAD = 4
#: Near duplicates: least similarity and length ratio. Coverage: least characters, share, and how much longer.
DUPLICATE_RATIO, DUPLICATE_LENGTHS = 0.70, 0.85
COVERED_CHARS, COVERED_RATIO, COVERED_LENGTHS = 40, 0.70, 1.35
#: Variants of a meaning; cards of the match kinds contains and body, and of a query.
VARIANTS, MOST_CONTAINS, MOST_BODY, MOST_CARDS = 3, 10, 6, 26
#: Name matches beyond which a non-Latin query does not look at bodies.
EXPAND_LIMIT = 8


def entry_rank(body: Column, quality: Column, authority: Column | None = None, kind: Column | None = None) -> Column:
    """Sort key of an entry: no placeholder, quality, length, authority, kind of translation."""
    return F.struct(tx.is_placeholder(body).alias("placeholder"), (-F.coalesce(quality, F.lit(0))).alias("quality"), (-F.length(body)).alias("size"), (authority if authority is not None else F.lit(0)).alias("authority"), (kind if kind is not None else F.lit(0)).alias("kind"))


def one_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def leaf_terms(entries: DataFrame) -> DataFrame:
    """Best entry of each (leaf, term) by leaf priority and source kind, first on ties, with its number of entries."""
    w = Window.partitionBy("leaf", "term")
    d = entries.withColumn("entries", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("priority", "kind_rank", "entry_id")))
    return d.where("_n = 1").drop("_n")


def term_leaves(entries: DataFrame) -> DataFrame:
    """``(term, leaves, entry_ids)`` of every term."""
    return entries.groupBy("term").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"), F.array_sort(F.collect_list("entry_id")).alias("entry_ids"))


def leaf_order(terms: DataFrame) -> DataFrame:
    """Terms of each leaf numbered by category rank, falling frequency, length and name."""
    w = Window.partitionBy("leaf").orderBy("cat_rank", F.desc("n"), F.length("term"), "term")
    return terms.withColumn("place", F.row_number().over(w))


def leaf_page(entries: DataFrame, name_part: str, ranks: dict[str, int], default: int, offset: int, limit: int) -> DataFrame:
    """A page of the terms of every leaf: ``(leaf, term, n, cat, place, total, of_cat)``.

    Terms whose name holds ``name_part``, ordered by the rank of their category, frequency, length and
    name; ``of_cat`` is the facet count of the category in the leaf.
    """
    from corpusq.operators.scope import rank_of

    t = entries.where(F.contains(F.lower("term"), F.lit(name_part.lower()))).groupBy("leaf", "term").agg(F.count("*").alias("n"), F.min("cat").alias("cat"))
    total, facets = t.groupBy("leaf").agg(F.count("*").alias("total")), t.groupBy("leaf", "cat").agg(F.count("*").alias("of_cat"))
    d = leaf_order(t.withColumn("cat_rank", rank_of(F.col("cat"), ranks, default))).where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return d.drop("cat_rank").join(total, "leaf").join(facets, ["leaf", "cat"])


def meaning_cards(entries: DataFrame) -> DataFrame:
    """Variants of each meaning: best three by primary flag and rank, each body once in its group.

    ``entries(entry_id, group_id, meaning_id, is_primary, body, definition_quality, variant_id)`` ->
    one row per kept variant with ``place`` in its meaning. A body is its variant id, else its text.
    """
    rank = entry_rank(F.col("body"), F.col("definition_quality"))
    w = Window.partitionBy("group_id", "meaning_id").orderBy(F.desc("is_primary"), rank, "entry_id")
    few = entries.withColumn("place", F.row_number().over(w)).where(F.col("place") <= VARIANTS)
    body = F.coalesce(F.nullif("variant_id", F.lit("")), F.sha2("body", 256))
    seen = Window.partitionBy("group_id", body).orderBy("meaning_id", "place")
    return few.withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")


def gram_set(body: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a definition's skeleton."""
    chars = F.filter(F.split(F.lower(tx.definition_skeleton(body)), ""), lambda c: c != "")
    grams = lambda cs: F.transform(cs, lambda c, i: F.when(i + n <= F.size(cs), F.concat(c, *(F.get(cs, i + j) for j in range(1, n)))))
    return F.array_distinct(F.filter(tx.let(chars, grams), lambda g: g.isNotNull()))


class _Cards:
    """Cards of one block by rising size: ``ids``, ``texts``, ``sizes``."""

    def __init__(self, ids: np.ndarray, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(sizes, kind="stable")
        self.ids, self.texts, self.sizes = ids[order], [texts[i] for i in order], sizes[order]

    def packed(self) -> bytes:
        # Not by Spark: a block is compressed once, however often it is sent.
        table = pa.table({"id": pa.array(list(self.ids)), "s": pa.array(self.texts, pa.large_string())})
        with pa.BufferOutputStream() as out:
            with pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table)
            return zlib.compress(out.getvalue())

    @classmethod
    def unpacked(cls, packed: bytes) -> _Cards:
        table = pa.ipc.open_stream(zlib.decompress(packed)).read_all()
        return cls(table["id"].to_pandas().to_numpy(), table["s"].to_pylist())

    def chunks(self, cards: int, chars: int) -> list[_Cards]:
        """Stretches of at most so many cards and characters, or a single card."""
        out, low, ends = [], 0, np.cumsum(self.sizes)
        while low < len(self.ids):
            before = ends[low] - self.sizes[low]
            high = max(low + 1, min(low + cards, int(np.searchsorted(ends, before + chars, "right"))))
            part = _Cards.__new__(_Cards)
            part.ids, part.texts, part.sizes = self.ids[low:high], self.texts[low:high], self.sizes[low:high]
            out.append(part)
            low = high
        return out


def _near_duplicates(a: Column, b: Column) -> Column:
    return (a.high + 1) >= DUPLICATE_LENGTHS * b.low


def _near_covered(a: Column, b: Column) -> Column:
    return (a.high >= COVERED_CHARS) & (b.high + 1 >= COVERED_LENGTHS * a.low)


def _all_pairs(measure, left: _Cards, right: _Cards, same: bool, key: object) -> Iterator[pd.DataFrame]:
    """The pairs of two blocks, or of one with itself, stretch by stretch, so that one stretch's index is held at a time."""
    parts = left.chunks(*measure.most)
    for n, theirs in enumerate(parts if same else right.chunks(*measure.most)):
        index = measure.side(theirs.texts)
        for ours in parts[: n + 1] if same else parts:
            for found in measure.pairs(ours, theirs, index, ours is theirs):
                if len(found["a"]):
                    yield pd.DataFrame({"group_id": pd.Series([key] * len(found["a"]), dtype=object), **found})


def _whole_groups(measure, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cards = _Cards(rows.card_id.to_numpy(), list(rows.s))
        return pd.concat([pd.DataFrame(columns=names), *_all_pairs(measure, cards, cards, True, keys[0])])[names]

    return run


def _block(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    cards = _Cards(rows.card_id.to_numpy(), list(rows.s))
    return rows[[*keys, "block"]].head(1).assign(cards=[cards.packed()])


def _block_pairs(measure, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = {side: packed for rows in batches for side, packed in zip(rows.side, rows.cards)}
        same = keys[-1] == keys[-2]
        if len(sides) == 2 - same:  # a block whose sizes all go on beside it may have no cards
            left, right = (_Cards.unpacked(sides[side]) for side in (0, 1 - same))
            for found in _all_pairs(measure, left, right, same, keys[0]):
                yield found[names]

    return run


def _compared(cards: DataFrame, keys: list[str], text: Column, measure) -> DataFrame:
    """Pairs of cards with equal keys, as ``measure`` finds them: ``(group_id, a, b, …)``.

    Groups that one task can compare are sent as they are. The others stand by size and are cut into
    blocks of about equal work; blocks whose sizes can pair meet. A block is compressed before it is sent,
    and a group has at most MOST_BLOCKS blocks, unless they had over MOST_CHARS characters: what is
    sent grows with the cards and not with their pairs. A task compares two blocks stretch by stretch.
    Cards without text or without others are left out.
    """
    kind = dict(cards.dtypes)
    schema = f"group_id {kind['group_id']}, a {kind['card_id']}, b {kind['card_id']}, {measure.columns}"
    d = stored(cards.select("card_id", *keys, text.alias("s")).where("s <> ''").withColumn("size", F.length("s").cast("long")))
    most_cards, most_chars = measure.dealt
    sizes = d.groupBy(*keys, "size").agg(F.count("*").alias("n"))
    blocks = F.greatest(F.ceil(F.sum("n") / most_cards), F.ceil(F.sum(F.col("n") * F.col("size")) / most_chars))
    blocks = F.greatest(F.least(blocks, F.lit(MOST_BLOCKS)), F.ceil(F.sum(F.col("n") * F.col("size")) / MOST_CHARS)).cast("long")
    work = F.col("n") * (F.col("size") + CARD_WORK)
    many = sizes.groupBy(*keys).agg(blocks.alias("blocks"), F.sum(work).alias("work")).where("blocks > 1")
    # Where the cards of each size lie on a group's line of work: the first and the last block of a size, of which a card takes one by its id.
    upto = F.sum(work).over(Window.partitionBy(*keys).orderBy("size"))
    at = sizes.join(many, keys).withColumn("_upto", upto).withColumn("_work", work)
    at = at.select(*keys, "size", F.expr("int((_upto - _work) * blocks div work)").alias("first"), F.expr("int((_upto - 1) * blocks div work)").alias("last"))
    spans = at.withColumn("block", F.explode(F.sequence("first", "last"))).groupBy(*keys, "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    large = checkpointed(spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "low", "high"))).alias("spans")))
    # A row for every DEALT_CARDS cards or DEALT_CHARS characters at most.
    few = F.broadcast(large) if large.count() <= SENT_GROUPS else large
    whole = d.join(few.select(*keys), keys, "left_anti").withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1")
    whole = whole.select(*keys, "card_id", "s").groupBy(*keys).applyInPandas(_whole_groups(measure, schema), schema)
    own = F.filter("spans", lambda x: (x.low <= F.col("size")) & (F.col("size") <= x.high))
    # Neighbouring blocks share a size only where that size goes on.
    block = tx.let(own, lambda of: F.get(of, F.pmod(F.xxhash64("card_id"), F.size(of)).cast("int")).block)
    kinds = ", ".join(f"`{k}` {kind[k]}" for k in keys)
    packed = d.join(few, keys).select(*keys, block.alias("block"), "card_id", "s").groupBy(*keys, "block").applyInPandas(lambda rows: _block(rows, keys), f"{kinds}, block int, cards binary")
    met = lambda x, y, side: F.struct(x.block.alias("i"), y.block.alias("j"), F.lit(side).alias("side"))
    mine = F.filter("spans", lambda x: x.block == F.col("block"))
    as_left = tx.let(mine, lambda m: F.transform(F.filter("spans", lambda y: (y.block >= F.col("block")) & measure.near(m[0], y)), lambda y: met(m[0], y, 0)))
    as_right = tx.let(mine, lambda m: F.transform(F.filter("spans", lambda x: (x.block < F.col("block")) & measure.near(x, m[0])), lambda x: met(x, m[0], 1)))
    sides = packed.join(few, keys).select(*keys, "cards", F.explode(F.concat(as_left, as_right)).alias("_at")).select(*keys, "_at.i", "_at.j", "_at.side", "cards")
    # By all keys: by the group alone, a large one would be one task. A given number is not lessened for few bytes.
    spread = BLOCK_PAIR_SPREAD * int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.repartition(spread, *keys, "i", "j").groupBy(*keys, "i", "j").applyInPandas(_block_pairs(measure, schema), schema)
    return whole.unionByName(dealt)


class _Similar:
    """Near duplicates: lengths within DUPLICATE_LENGTHS, n-gram Jaccard at least ``least``."""

    def __init__(self, least: float):
        self.least = least

    def may(self, short: np.ndarray, long: np.ndarray) -> bool:
        """Whether some size of the first span is within the ratio of a size of the second that is as large or larger."""
        return short[0] <= long[1] and short[1] >= DUPLICATE_LENGTHS * long[0]

    def near(self, a: Column, b: Column) -> Column:
        return _near_duplicates(a, b)

    def __call__(self, short, long, n_short, n_long, both):
        return (short >= DUPLICATE_LENGTHS * long) & (both / np.maximum(1.0, n_short + n_long - both.astype(np.float64)) >= self.least)


class _Covered:
    """Coverage: COVERED_CHARS, COVERED_LENGTHS and the share COVERED_RATIO of the shorter card's n-grams."""

    def may(self, short: np.ndarray, long: np.ndarray) -> bool:
        return short[1] >= COVERED_CHARS and long[1] >= COVERED_LENGTHS * short[0]

    def near(self, a: Column, b: Column) -> Column:
        return _near_covered(a, b)

    def __call__(self, short, long, n_short, n_long, both):
        return (short >= COVERED_CHARS) & (long >= COVERED_LENGTHS * short) & (both.astype(np.float64) / np.maximum(1, n_short) >= COVERED_RATIO)


class _ByGrams:
    """Pairs of cards by the n-grams they share, ``a`` and ``b`` in no order; ``keep`` says which pass."""

    columns = "size_a long, size_b long, n_a long, n_b long, shared long"

    def __init__(self, keep):
        self.keep, self.most, self.dealt = keep, (DEALT, DEALT_TEXT), (DEALT, DEALT_TEXT)

    def near(self, a: Column, b: Column) -> Column:
        """Whether a block of the sizes ``a`` may have pairs with one of the sizes ``b``, that are as large or larger."""
        return self.keep.near(a, b)

    def side(self, cards: list[str]) -> Grams:
        return Grams([trigrams(s) for s in cards])

    def pairs(self, left: _Cards, right: _Cards, grams: Grams, same: bool) -> Iterator[dict]:
        own = grams if same else self.side(left.texts)
        windows = []
        for a in range(0, len(left.ids), TILE):
            b = min(a + TILE, len(left.ids))
            for c in range(a if same else 0, len(right.ids), TILE):
                d = min(c + TILE, len(right.ids))
                spans = left.sizes[[a, b - 1]], right.sizes[[c, d - 1]]
                if self.keep.may(*spans) or self.keep.may(*spans[::-1]):
                    windows.append((a, b, c, d))
        for a, c, both in shared(own, grams, windows):
            x, y = np.arange(a, a + both.shape[0])[:, None], np.arange(c, c + both.shape[1])[None, :]
            sx, sy, nx, ny = left.sizes[x], right.sizes[y], own.counts[x], grams.counts[y]
            ok = self.keep(np.minimum(sx, sy), np.maximum(sx, sy), np.where(sx <= sy, nx, ny), np.where(sx <= sy, ny, nx), both)
            i, j = np.nonzero(ok & (y > x) if same else ok)
            m, i, j = both[i, j].astype(np.int64), i + a, j + c
            other = left.ids[i] != right.ids[j]
            i, j, m = i[other], j[other], m[other]
            yield {"a": left.ids[i], "b": right.ids[j], "size_a": left.sizes[i], "size_b": right.sizes[j], "n_a": own.counts[i], "n_b": grams.counts[j], "shared": m}


def card_pairs(cards: DataFrame, keys: list[str], keep) -> DataFrame:
    """``(group_id, a, b, size_a, size_b, n_a, n_b, shared)``: pairs of cards with equal keys, the first of them ``group_id``, that ``keep`` lets through.

    ``shared`` is exact; only pairs that pass leave the task.
    """
    return _compared(cards, keys, F.lower(tx.definition_skeleton(F.col("body"))), _ByGrams(keep))


def duplicate_pairs(cards: DataFrame, least: float = DUPLICATE_RATIO) -> DataFrame:
    """Pairs of one group within the length band and with n-gram Jaccard at least ``least``."""
    p = card_pairs(cards, ["group_id"], _Similar(least))
    similarity = F.col("shared") / F.greatest(F.lit(1), F.col("n_a") + F.col("n_b") - F.col("shared"))
    return p.select("group_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), similarity.alias("similarity"))


def _dealt_blocks(cards: DataFrame, keys: list[str], band: float | None) -> DataFrame:
    """Cards as sides of block pairs, 0 left, 1 right, 2 right from the next band: ``(…keys, band, i, j, side, card_id, s)``.

    A card meets all others of its keys; a group with over DEALT_CARDS cards or DEALT_CHARS characters is
    dealt over pairs of blocks, and then, with ``band``, only lengths that differ by less than about
    that ratio meet, and a band is dealt over as many blocks as it and the next one need. Cards without a
    skeleton or without others are left out. The plain dealing of single cards: queries send packed
    blocks instead (``_compared``), as this sends a card once for every block of its group.
    """
    d = cards.select("card_id", *keys, tx.definition_skeleton(F.col("body")).alias("s")).where("s <> ''")
    d = checkpointed(d.withColumn("size", F.length("s")))
    blocks = F.greatest(F.ceil(F.col("n") / DEALT_CARDS), F.ceil(F.col("chars") / DEALT_CHARS)).cast("int")
    many = [F.count("*").alias("n"), F.sum("size").alias("chars")]
    sizes = d.groupBy(*keys).agg(*many).where("n > 1")
    d = d.join(sizes.select(*keys, blocks.alias("blocks")), keys)
    place = lambda i, j, b, side: F.struct(i.alias("i"), j.alias("j"), b.alias("band"), F.lit(side).alias("side"))
    b, block = F.col("band"), lambda of: F.expr(f"cast(pmod(xxhash64(card_id), {of}) as int)")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    both = F.concat(F.transform(every("blocks"), lambda k: place(block("blocks"), k, b, 0)), F.transform(every("blocks"), lambda k: place(k, block("blocks"), b, 1)))
    if band:
        d = d.withColumn("band", F.when(F.col("blocks") > 1, F.floor(F.log(F.col("size")) / -math.log(band))).otherwise(0))
        # A band's blocks are of its own cards and of those of the next one, which it meets too.
        own = d.where("blocks > 1").groupBy(*keys, "band").agg(*many)
        met = own.unionByName(own.withColumn("band", b - 1)).groupBy(*keys, "band").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).select(*keys, "band", blocks.alias("_blocks"))
        d = d.join(met, [*keys, "band"], "left").withColumn("blocks", F.coalesce("_blocks", "blocks")).drop("_blocks")
        d = d.join(met.select(*keys, (b + 1).alias("band"), F.col("_blocks").alias("before")), [*keys, "band"], "left")
        places = F.when(F.col("before").isNotNull(), F.concat(both, F.transform(every("before"), lambda k: place(k, block("before"), b - 1, 2)))).otherwise(both)
    else:
        d, places = d.withColumn("band", F.lit(0).cast("long")), both
    sides = d.withColumn("_at", F.explode(places)).select(*keys, "_at.band", "_at.i", "_at.j", "_at.side", "card_id", "s")
    # By all keys: by the group alone, a large one would be one task. A given number is not lessened for few bytes.
    spread = BLOCK_PAIR_SPREAD * int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sides.repartition(spread, *keys, "band", "i", "j")


def _least(total: np.ndarray, share: float, times: float) -> np.ndarray:
    """The least m with ``times * m / total >= share`` in floating point, for totals above 0."""
    m = np.maximum(0, np.floor(share * total / times).astype(np.int64) - 2)
    while (low := times * m / total < share).any():
        m += low
    return m


class _ByBlocks:
    """Pairs of cards by their matching blocks.

    Duplicates pair in the order of their ids, each pair once; coverage pairs a shorter left card with a longer right one.
    """

    columns = "n_a long, n_b long, matched long"

    def __init__(self, duplicates: bool):
        self.duplicates, self.most, self.dealt = duplicates, (DEALT_CARDS, DEALT_CHARS), (DEALT_CARDS, DEALT_CHARS)

    def near(self, a: Column, b: Column) -> Column:
        return _near_duplicates(a, b) if self.duplicates else _near_covered(a, b)

    def side(self, cards: list[str]) -> Shelf:
        return Shelf([Text(s) for s in cards])

    def pairs(self, left: _Cards, right: _Cards, shelf: Shelf, same: bool) -> Iterator[dict]:
        ids, sizes, place = right.ids, right.sizes, np.arange(len(right.ids))
        out = []
        for i, (card, text, n) in enumerate(zip(left.ids, left.texts, left.sizes)):
            if self.duplicates:
                asked = (np.minimum(n, sizes) / np.maximum(n, sizes) >= DUPLICATE_LENGTHS) & (ids != card)
                asked &= (place > i) | (not same)
                least, x_left = _least(n + sizes, DUPLICATE_RATIO, 2.0), card < ids
            else:
                asked = (n >= COVERED_CHARS) & (sizes >= n * COVERED_LENGTHS) & (ids != card)
                least, x_left = np.full(len(ids), _least(np.array([n]), COVERED_RATIO, 1.0)[0]), np.ones(len(ids), bool)
            if asked.any():
                found = shelf.matches(Text(text), asked, least, x_left)
                out += [(i, t, m) for t, m in found.items()]
        i, t, m = np.array(out, np.int64).reshape(-1, 3).T
        turn = np.array(left.ids[i] > ids[t], bool) if self.duplicates else np.zeros(len(i), bool)
        pick = lambda x, y: (np.where(turn, y, x), np.where(turn, x, y))
        (a, b), (n_a, n_b) = pick(left.ids[i], ids[t]), pick(left.sizes[i], sizes[t])
        yield {"a": a, "b": b, "n_a": n_a, "n_b": n_b, "matched": m}


def _matching(cards: DataFrame, keys: list[str], duplicates: bool) -> DataFrame:
    return _compared(cards, keys, tx.definition_skeleton(F.col("body")), _ByBlocks(duplicates))


def matching_pairs(cards: DataFrame) -> DataFrame:
    """``(group_id, a, b, similarity)``: near duplicates of one group by their matching blocks.

    Lengths within DUPLICATE_LENGTHS, and twice the characters in matching blocks at least
    DUPLICATE_RATIO of both lengths, the card with the smaller id on the left. Candidates come from an
    index of segments of the other cards: the longest common stretch bounds what can match at all.
    """
    p = _matching(cards, ["group_id"], True)
    return p.select("group_id", "a", "b", (2.0 * F.col("matched") / (F.col("n_a") + F.col("n_b"))).alias("similarity"))


def matching_coverage(cards: DataFrame) -> DataFrame:
    """``(group_id, short, long, n_short, share)``: cards of COVERED_CHARS or more that a much longer card of the group covers.

    The share of the shorter card in matching blocks is at least COVERED_RATIO. With a column
    ``bucket`` only cards of one bucket are compared.
    """
    p = _matching(cards, ["group_id", *(["bucket"] if "bucket" in cards.columns else [])], False)
    return p.select("group_id", F.col("a").alias("short"), F.col("b").alias("long"), F.col("n_a").alias("n_short"), (F.col("matched") / F.col("n_a")).alias("share"))


def clusters(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(card_id, cluster)``: transitive closure of pairs inside groups, smallest card id of each.

    Smallest labels spread over the pairs, and every label is replaced by the label that its card
    has, until none changes; each round is checkpointed.
    """
    # Both directions from one row: a union would find all pairs twice.
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = checkpointed(pairs.select(ways.alias("_way")).select("_way.a", "_way.b"))
    label = cards.select("card_id", F.col("card_id").alias("cluster"))
    moved = True
    while moved:
        spread = edges.join(label, F.col("b") == F.col("card_id")).groupBy(F.col("a").alias("card_id")).agg(F.min("cluster").alias("near"))
        new = checkpointed(label.join(spread, "card_id", "left").select("card_id", F.least("cluster", "near").alias("cluster"), F.coalesce(F.col("near") < F.col("cluster"), F.lit(False)).alias("changed")))
        moved = not new.where("changed").isEmpty()
        up = new.groupBy(F.col("card_id").alias("cluster")).agg(F.min("cluster").alias("above"))
        label = checkpointed(new.join(up, "cluster", "left").select("card_id", F.least("cluster", "above").alias("cluster")))
    return label


def dedupe_cards(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """The best card of each cluster of near duplicates, with ``cluster``: by forced, coverage and rank as ``assemble_cards`` has them."""
    d = cards.join(clusters(cards, pairs), "card_id").join(coverage_rank(cards), "card_id")
    return one_per_key(d, ["cluster"], _primary_order()).select(*cards.columns, "cluster")


def coverage(cards: DataFrame) -> DataFrame:
    """``(group_id, short, long, n_short, share)``: cards whose n-grams a much longer card of the group holds.

    With a column ``bucket`` only cards of one bucket are compared.
    """
    p = card_pairs(cards, ["group_id", *(["bucket"] if "bucket" in cards.columns else [])], _Covered())
    flip = F.col("size_a") > F.col("size_b")
    pick = lambda c, s, o: F.when(flip, F.col(f"{c}{o}")).otherwise(F.col(f"{c}{s}"))
    share = F.col("shared") / F.greatest(F.lit(1), pick("n_", "a", "b"))
    return p.select("group_id", pick("", "a", "b").alias("short"), pick("", "b", "a").alias("long"), pick("size_", "a", "b").alias("n_short"), share.alias("share"))


def coverage_rank(cards: DataFrame) -> DataFrame:
    """``(card_id, covers, chars_covered)`` of every card, among all cards of its group."""
    c = matching_coverage(cards.drop("bucket")).groupBy(F.col("long").alias("card_id")).agg(F.count("*").alias("covers"), F.sum("n_short").cast("long").alias("chars_covered"))
    return cards.select("card_id").join(c, "card_id", "left").select("card_id", F.coalesce("covers", F.lit(0)).alias("covers"), F.coalesce("chars_covered", F.lit(0)).alias("chars_covered"))


def prune_covered(cards: DataFrame, forced: str = "forced") -> DataFrame:
    """Cards without those that a card of their version bucket covers; forced ones stay, and a bucket keeps at least its longest."""
    gone = matching_coverage(cards).select(F.col("short").alias("card_id")).distinct().withColumn("covered", F.lit(True))
    d = cards.join(gone, "card_id", "left").withColumn("_stay", F.col("covered").isNull() | F.col(forced))
    keys = ["group_id", *(["bucket"] if "bucket" in cards.columns else [])]
    of = d.groupBy(*keys).agg(F.max(F.col("_stay").cast("int")).alias("_any"), F.max_by("card_id", F.struct(F.length(tx.definition_skeleton(F.col("body"))), -F.col("card_id"))).alias("_longest"))
    return d.join(of, keys).where("_stay or (_any = 0 and card_id = _longest)").select(*cards.columns)


def _primary_order() -> list[Column]:
    return [F.desc("forced"), F.desc("covers"), F.desc("chars_covered"), F.when(F.col("bucket") == "normal", 0).when(F.col("bucket") == "special", 1).otherwise(2), F.when(F.col("bucket") != "other", F.col("version")).otherwise(0), F.desc("is_primary"), entry_rank(F.col("body"), F.col("definition_quality")), F.col("card_id")]


def assemble_cards(cards: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Primary card of each group and the rest in order: ``place`` 1 is the primary.

    ``cards(card_id, group_id, body, forced, bucket, version, is_primary, definition_quality)``;
    ``ranked`` are the cards before pruning, over which coverage counts. The primary comes from the
    bucket ``normal`` where a group has that and ``special``: by forced, cards and characters
    covered, normal before special, version, primary flag, entry rank. The others follow by coverage,
    special before normal, version, primary flag, entry rank.
    """
    d = cards.join(coverage_rank(cards if ranked is None else ranked), "card_id")
    has = lambda b: F.max((F.col("bucket") == b).cast("int"))
    pools = d.groupBy("group_id").agg((has("normal") + has("special") == 2).alias("_both"))
    d = d.join(pools, "group_id").withColumn("_out", F.col("_both") & (F.col("bucket") != "normal"))
    w = Window.partitionBy("group_id")
    d = d.withColumn("_first", F.row_number().over(w.orderBy("_out", *_primary_order())) == 1)
    rest = [F.desc("covers"), F.desc("chars_covered"), F.when(F.col("bucket") == "special", 0).when(F.col("bucket") == "normal", 1).otherwise(2), F.when(F.col("bucket") != "other", F.col("version")).otherwise(0), F.desc("is_primary"), entry_rank(F.col("body"), F.col("definition_quality")), F.col("card_id")]
    return d.withColumn("place", F.row_number().over(w.orderBy(F.desc("_first"), *rest))).drop("_first", "_out", "_both")


def conflict_flags(entries: DataFrame) -> DataFrame:
    """``(group_id, flags)``: flags of all entries of a group, each once, in order of the entries."""
    rows = entries.select("group_id", "entry_id", F.posexplode("conflict_flags").alias("at", "flag"))
    first = rows.groupBy("group_id", "flag").agg(F.min(F.struct("entry_id", "at")).alias("o"))
    return first.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "flag"))), lambda x: x.flag).alias("flags"))


def majority(entries: DataFrame, member: Column, by: list[str]) -> DataFrame:
    """``(…by, majority)``: whether over half of the entries satisfy ``member``."""
    return entries.groupBy(*by).agg((F.sum(member.cast("int")) * 2 > F.count("*")).alias("majority"))


def match_entries(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """``(query_id, entry_id, match)``: exact names, names that contain, bodies that contain.

    Names come from a table of their suffixes, bodies from one scan for few queries, from a verified
    equi-join on grams for many. A
    non-Latin query with more than EXPAND_LIMIT names does not look at bodies. An entry stands under
    its best match.
    """
    from corpusq.operators import occurrences

    terms = queries.select("query_id", F.col("q").alias("term"))
    names = entries.select(F.col("entry_id").alias("doc"), F.col("term").alias("text"))
    bodies = entries.select(F.col("entry_id").alias("doc"), F.lit(0).alias("ord"), F.col("body").alias("text"))
    few = [r.term for r in terms.where(occurrences._piece(F.col("term")) != "").select("term").distinct().limit(occurrences.FEW_TERMS + 1).collect()]
    if len(few) <= occurrences.FEW_TERMS:
        held = F.array_compact(F.array(*(F.when(tx.matches(F.col("text"), F.lit(t)), F.lit(t)) for t in few))) if few else F.expr("cast(array() as array<string>)")
        near = bodies.select("doc", F.explode(held).alias("term")).join(F.broadcast(terms.distinct()), "term")
    else:
        near = occurrences.near_blocks(terms, bodies).join(bodies.drop("ord"), "doc").where(tx.matches(F.col("text"), F.col("term")))
    in_body = near.select("query_id", F.col("doc").alias("entry_id"), F.lit("body").alias("match"))
    latin = tx.is_latin(F.col("term"))
    held = names_with(queries.select("query_id", F.trim("q").alias("q")), names.select(F.col("text").alias("name")))
    in_name = held.join(names, held["name"] == names["text"]).join(terms, "query_id")
    in_name = in_name.select("query_id", F.col("doc").alias("entry_id"), F.when(F.lower("text") == F.lower(F.trim("term")), "exact").otherwise("contains").alias("match"))
    count = in_name.groupBy("query_id").agg(F.count("*").alias("names"))
    gate = terms.join(count, "query_id", "left").where(latin | (F.coalesce("names", F.lit(0)) <= EXPAND_LIMIT)).select("query_id")
    every = in_name.unionByName(in_body.join(gate, "query_id", "left_semi"))
    best = F.min(F.when(F.col("match") == "exact", 0).when(F.col("match") == "contains", 1).otherwise(2))
    return every.groupBy("query_id", "entry_id").agg(best.alias("r")).select("query_id", "entry_id", F.element_at(F.array(F.lit("exact"), F.lit("contains"), F.lit("body")), F.col("r") + 1).alias("match"))


def rank_definitions(matched: DataFrame) -> DataFrame:
    """Definitions of each query in order, one per group: ``place``.

    Exact before contains before body; a group stays with its best match only. Inside: placeholders
    last, family, then length (exact), frequency, prefix and length of the name (contains), density
    of the query (body). ``matched(query_id, q, match, group_id, entry_id, term, body, family, freq)``.
    """
    bucket = F.when(F.col("match") == "exact", 0).when(F.col("match") == "contains", 1).otherwise(2)
    hits = F.regexp_count(F.lower("body"), F.concat(F.lit("\\Q"), F.lower("q"), F.lit("\\E")))
    first = F.when(bucket == 0, tx.is_placeholder(F.col("body")).cast("int")).when(bucket == 1, -F.coalesce("freq", F.lit(0))).otherwise(-hits)
    second = F.when(bucket == 0, -F.length("body")).when(bucket == 1, (~F.startswith(F.lower("term"), F.lower("q"))).cast("int")).otherwise(F.length("body"))
    d = matched.withColumns({"bucket": bucket, "first": first.cast("long"), "second": second.cast("long")})
    order = [F.col("bucket"), F.col("family"), F.col("first"), F.col("second"), F.length("term"), F.col("entry_id")]
    d = one_per_key(d, ["query_id", "group_id"], order)
    return d.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("first", "second")


def cap_cards(ranked: DataFrame) -> DataFrame:
    """At most MOST_CONTAINS, MOST_BODY and MOST_CARDS cards of a query; exact ones are not capped by kind."""
    most = F.when(F.col("match") == "contains", MOST_CONTAINS).when(F.col("match") == "body", MOST_BODY).otherwise(1 << 30)
    d = ranked.withColumn("in_match", F.row_number().over(Window.partitionBy("query_id", "match").orderBy("place"))).where(F.col("in_match") <= most)
    return d.withColumn("card", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("card") <= MOST_CARDS)


def first_non_empty(parts: DataFrame) -> DataFrame:
    """Of ``parts(query_id, part_ord, …)`` the rows of each query's first part that has any."""
    w = Window.partitionBy("query_id").orderBy("part_ord")
    return parts.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def override_bodies(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Bodies after the overrides ``(term, doc, prefix, replacement)``, a small curated table."""
    d = entries.join(overrides, ["term", "doc"], "left")
    body = F.when(F.col("replacement").isNotNull(), F.col("replacement")).when(F.col("prefix").isNotNull() & ~F.startswith("body", "prefix"), F.concat("prefix", "body")).otherwise(F.col("body"))
    return d.withColumn("body", body).select(*entries.columns)
