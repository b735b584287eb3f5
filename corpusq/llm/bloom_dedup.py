"""Exact de-duplication by two passes over a Bloom filter.

Pass one puts the hash of every text in a Bloom filter that also marks the bits set twice or more.
A text that repeats has all its bits marked so; pass two tests every row against those marks. Only
rows that pass meet in a shuffle, by their full SHA-256, which decides; all others go straight
through as groups of one. A false positive costs a row in the shuffle and nothing else, so the
filter's size is bounded by a parameter at any corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.scratch import materialize

#: Bits that each text sets.
PROBES = 3
#: Bits of the filter per text, and bounds for their sum: 32 MB at most go to an executor.
BITS_PER_TEXT, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: Bits of one segment of the filter.
SEGMENT = 1 << 16


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), " \t\n\x0b\f\r", "")


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash, one row per probe (double hashing)."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def _marks(bits: int):
    """Rows (segment, once, twice): the positions in a segment that a task has set once, or oftener."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, times = np.unique(_positions(frame.h.to_numpy(), bits), return_counts=True)
            segment = at // SEGMENT
            cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]) if len(at) else [0]
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                low = (at[a:b] % SEGMENT).astype(np.uint16)
                more = times[a:b] > 1
                rows.append((int(segment[a]), low[~more].tobytes(), low[more].tobytes()))
            yield pd.DataFrame(rows, columns=["segment", "once", "twice"])

    return run


def _twice(group: pd.DataFrame) -> pd.DataFrame:
    """The bitmap of a segment's positions that are set twice or more in all."""
    count = np.zeros(SEGMENT, np.uint8)
    for once, twice in group[["once", "twice"]].itertuples(index=False):
        at = np.frombuffer(once, np.uint16)
        count[at] = np.minimum(count[at] + 1, 2)
        count[np.frombuffer(twice, np.uint16)] = 2
    return pd.DataFrame({"segment": [group.segment.iloc[0]], "bitmap": [np.packbits(count == 2).tobytes()]})


def repeated_filter(hashes: DataFrame, texts: int, most_bits: int = MOST_BITS) -> tuple[bytes, int]:
    """(bitmap, bits) of the positions that two or more of ``hashes(h long)`` set."""
    bits = LEAST_BITS
    while bits < min(most_bits, BITS_PER_TEXT * texts):
        bits *= 2
    marks = hashes.mapInPandas(_marks(bits), "segment long, once binary, twice binary")
    bitmap = bytearray(bits // 8)
    for row in marks.groupBy("segment").applyInPandas(_twice, "segment long, bitmap binary").toLocalIterator():
        at = row.segment * SEGMENT // 8
        bitmap[at : at + SEGMENT // 8] = row.bitmap[: len(bitmap) - at]
    return bytes(bitmap), bits


def _maybe_repeated(docs: DataFrame, bitmap: bytes, bits: int) -> DataFrame:
    """``docs`` with a column ``again``: all positions of the row's hash ``h`` are set in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def again(h: pd.Series) -> pd.Series:
        marks = np.frombuffer(shared.value, np.uint8)
        at = _positions(h.to_numpy(), bits)
        return pd.Series((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(0))

    return docs.withColumn("again", again("h"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for every row of ``docs``.

    Texts are equal when they are identical without white space (``normalised``); null counts as
    empty, and empty texts equal each other. Of equal texts the one with the most code points before
    normalising is kept, then the smallest id. Rows without an id come last, and
    ``keep_first_copies`` never drops them. Other columns are ignored; an empty table gives an empty one.
    """
    d, bitmap, bits = _hashed(docs, id_col, text_col, most_bits)
    d = _maybe_repeated(d, bitmap, bits)
    alone = d.where(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(_met(d.where("again")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def _hashed(docs: DataFrame, id_col: str, text_col: str, most_bits: int) -> tuple[DataFrame, bytes, int]:
    """Narrow rows (doc_id, size, text_sha256, h), and the filter over them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("size"), F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256).alias("text_sha256"))
    d = materialize(d.withColumn("h", F.xxhash64("text_sha256")), "hashes")
    return d, *repeated_filter(d.select("h"), d.count(), most_bits)


def _met(maybe: DataFrame) -> DataFrame:
    """The rows that meet, by full hash: with ``keep_id``, ``group_size`` and ``kept``.

    The groups are written first, so that both sides of the join are plain shuffles, of which
    adaptive execution splits the partition of a hash with very many rows.
    """
    best = maybe.groupBy("text_sha256").agg(F.max(F.struct("size", (-F.col("doc_id")).alias("less"))).alias("best"), F.count("*").alias("group_size"))
    best = materialize(best.select("text_sha256", F.col("best.size").alias("most"), (-F.col("best.less")).alias("keep_id"), "group_size"), "groups")
    return maybe.join(best, "text_sha256").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("most")))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with the columns they came with.

    Rows that the filter tells apart go straight through; only the others meet their group. Ids need
    not be unique: a row goes for its own text alone, and of rows with one id, equal texts and equal
    length one stays. Rows without an id all stay.
    """
    d, bitmap, bits = _hashed(docs, id_col, text_col, most_bits)
    gone = _met(_maybe_repeated(d, bitmap, bits).where("again")).where(~F.col("kept") & F.col("doc_id").isNotNull())
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_size"), sha.alias("_sha")).withColumn("h", F.xxhash64("_sha"))
    rows = _maybe_repeated(rows, bitmap, bits)
    left = rows.where("again and _id is not null").join(gone, ["_id", "_size", "_sha"], "left_anti").dropDuplicates(["_id", "_size", "_sha"])
    return rows.where(~F.col("again") | F.col("_id").isNull()).select("row.*").unionByName(left.select("row.*"))
