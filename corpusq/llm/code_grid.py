"""Vector code compression: product codes by integer k-means, nearest entries by memoised grid cells.

Vectors are cut into equal parts, and every part is replaced by the nearest entry of its position's
codebook. The nearest entry is found through a grid: a part's coarse cell is looked up in a memo;
for a new cell, every entry's least and greatest distance to any point of the cell's box is taken,
and entries whose least distance exceeds another entry's greatest are dominated: they are nearest to
no point of the box. The others are kept in the memo, and only they are evaluated exactly.

All arithmetic is on integers. Rows whose vector is null, holds a null, NaN or infinite component,
or has another length than the vector of the smallest kept id, are dropped. Null ids come last.
Repeated ids are rows of their own, in the order of their vectors. A length that 4 does not divide
is cut at the floors of its quarters. With fewer than 256 rows the codebooks have as many entries. An
empty table gives no rows. A component of 2^24 or more after scaling (2^14 before) is an error, as
distances might leave the range of longs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm import textops as tx
from corpusq.llm.scratch import materialize

#: Entries of a codebook, parts of a vector, rounds of k-means, and the factor before flooring.
ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Side of a cell as a share of the entries' standard deviation; cells that a task's memo holds.
CELL, MOST_CELLS = 0.25, 1 << 16
#: Cells whose bounds are taken at once; rows whose distances are taken at once.
AT_ONCE, ROWS = 512, 4096
LARGEST = 1 << 24
#: Copies of a label's sum that its rows are dealt over.
SALT = 32


class Grid:
    """Nearest entries of one codebook, for any number of parts of vectors."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.norm = entries, (entries.astype(np.float64) ** 2).sum(1)
        self.side = max(1, int(CELL * entries.std())) if entries.size else 1
        self.memo: dict[bytes, np.ndarray] = {}

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell, the entries that are nearest to some point of its box, and possibly others."""
        low = cells * self.side
        centre, half = low + (self.side - 1) / 2, (self.side - 1) / 2
        # Beyond the nearest centre distance plus the box's diagonal an entry is dominated without looking at the box.
        far = np.sqrt(np.maximum(0, (centre**2).sum(1)[:, None] - 2 * centre @ self.entries.T.astype(np.float64) + self.norm))
        near = far <= (far.min(1) + 2 * half * np.sqrt(cells.shape[1]))[:, None] * (1 + 1e-9) + 1e-3
        cell, entry = np.nonzero(near)
        off = np.abs(self.entries[entry] - centre[cell])
        most, least = ((off + half) ** 2).sum(1), (np.maximum(off - half, 0) ** 2).sum(1)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        keep = least <= np.minimum.reduceat(most, first)[cell]
        return np.split(entry[keep], np.searchsorted(cell[keep], np.arange(1, len(cells))))

    def _candidates(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of all entries to evaluate, by row and then entry."""
        cells = parts // self.side
        keys = np.ascontiguousarray(cells.astype(np.int32)).view(np.dtype((np.void, max(1, 4 * cells.shape[1])))).ravel() if cells.shape[1] else np.zeros(len(cells), "V1")
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        names = [keys[i].tobytes() for i in first]
        if len(self.memo) + len(names) > MOST_CELLS:
            self.memo.clear()
        new = [k for k, name in enumerate(names) if name not in self.memo]
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            self.memo.update(zip((names[k] for k in some), self._undominated(cells[first[some]])))
        held = [self.memo[name] for name in names]
        sizes = np.array([len(h) for h in held])
        starts = np.cumsum(sizes) - sizes
        return np.repeat(np.arange(len(parts)), sizes[which]), np.concatenate(held)[tx.ranges(starts[which], sizes[which])]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part's nearest entry, the lower index on ties."""
        row, entry = self._candidates(parts)
        off = parts[row] - self.entries[entry]
        key = np.einsum("ij,ij->i", off, off) * ENTRIES + entry
        best = np.minimum.reduceat(key, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
        return best % ENTRIES, best // ENTRIES


def cuts(dim: int) -> list[int]:
    return [dim * p // PARTS for p in range(PARTS + 1)]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), dim)


def _assigned(batch: pa.RecordBatch, at: int, grids: list[Grid], dim: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, vectors, nearest of each part) of slices of a batch."""
    edge = cuts(dim)
    for lo in range(0, batch.num_rows, ROWS):
        v = _vectors(batch.column(at).slice(lo, ROWS), dim)
        yield lo, v, [g.nearest(v[:, a:b]) for g, a, b in zip(grids, edge, edge[1:])]


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """Kept rows ``(vec_id, label, v)`` with integer vectors of one length, written once, and that length."""
    x = F.col(vector)
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(SCALE * c.cast("double")))
    fits = F.forall("v", lambda c: (c < LARGEST) & (c > -LARGEST))
    d = rows.where(sound).select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))
    d = d.withColumn("v", F.when(fits, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}"))))
    d = materialize(d, "vectors")
    first = d.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("dim")).first()
    dim = first.dim if first else 0
    return d.where(F.size("v") == dim), dim


def first_codebooks(kept: DataFrame, dim: int) -> list[np.ndarray]:
    """The parts of the ENTRIES rows with the smallest ids."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    v, edge = np.array([r.v for r in rows], np.int64).reshape(len(rows), dim), cuts(dim)
    return [v[:, a:b] for a, b in zip(edge, edge[1:])]


def refined(kept: DataFrame, dim: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: every used entry becomes the floor of its parts' mean.

    Tasks send a row of sums per part and entry; what reaches the driver are the PARTS x ENTRIES totals.
    """
    edge = cuts(dim)
    width = max(b - a for a, b in zip(edge, edge[1:]))
    held = kept.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in held.value]
        count, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            for _, v, found in _assigned(batch, 0, grids, dim):
                for p, (code, _) in enumerate(found):
                    np.add.at(count[p], code, 1)
                    np.add.at(total[p, :, : edge[p + 1] - edge[p]], code, v[:, edge[p] : edge[p + 1]])
        part, entry = np.nonzero(count)
        columns = [part, entry, count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
        tx.give_back()

    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]
    partial = kept.select("v").mapInArrow(sums, ", ".join(f"{c} long" for c in names))
    out = [b.copy() for b in books]
    for r in partial.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:])).collect():
        out[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(out[r.part].shape[1])]
    return out


def encode(kept: DataFrame, dim: int, books: list[np.ndarray]) -> DataFrame:
    """``(vec_id, label, code, error)``: the nearest entries' indexes, two hex digits a part, and the summed squared distance."""
    held = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in held.value]
        for batch in batches:
            for lo, v, found in _assigned(batch, 2, grids, dim):
                codes = np.stack([code for code, _ in found], 1).astype(np.uint8)
                error = sum(d for _, d in found)
                text = pa.array([c.tobytes().hex() for c in codes], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, len(v)) for i in (0, 1)), text, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
        tx.give_back()

    kinds = dict(kept.dtypes)
    return kept.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components, joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()


def compress(rows: DataFrame, rounds: int = ROUNDS, **columns: str) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes ``(vec_id, label, code, error)`` of all kept rows, written once, and the codebooks."""
    kept, dim = integer_vectors(rows, **columns)
    books = first_codebooks(kept, dim)
    for _ in range(rounds):
        books = refined(kept, dim, books)
    return materialize(encode(kept, dim, books), "codes"), books


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([b[int(code[2 * p : 2 * p + 2], 16)] for p, b in enumerate(books)])


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors of all rows of the label; null labels are one.

    Sums are made inside partitions first and come back over SALT copies, so that a label's rows spread.
    """
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    d = codes.withColumn("_salt", F.pmod(F.xxhash64("code", "vec_id"), F.lit(SALT)).cast("int"))
    same = (F.col("c.label").eqNullSafe(F.col("s.label"))) & (F.col("c._salt") == F.col("s._salt"))
    return d.alias("c").join(salted.alias("s"), same).select("c.vec_id", "c.label", "c.code", "c.error", "s.label_error")
