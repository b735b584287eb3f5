"""SentencePiece encoding and decoding with N-best segmentations.

A text is a lattice of the pieces that match at each place. Forward Viterbi scores give the best
segmentation, and are exact heuristics for a backward A-star search that yields the next best in
order. No piece crosses the start of a word, so a text's lattice is a chain of word lattices: each
distinct word gets its Viterbi scores once, and the loss of its second best. A text's n best differ
from the best in at most n - 1 words, those whose second best loses least; the A-star search lists
the n best of these words, and the text's n best are put together from them.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.llm import textops as tx

SPACE = "▁"
#: Words that a worker remembers with their best, and with their n best; the score of a byte piece lies this far below the lowest piece.
REMEMBERED, LISTED, BYTE_PENALTY = 600_000, 50_000, 10.0
#: Pieces with lower scores are placeholders for runs of spaces, which any other path beats.
UNUSABLE = -1e8


class Lattice:
    """The pieces of a model, and the search over the lattice of one word."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.text: dict[int, bytes] = {}
        self.byte: dict[int, int] = {}
        lowest = min(s for s in map(model.get_score, range(model.get_piece_size())) if s > UNUSABLE)
        self.byte_score = lowest - BYTE_PENALTY
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not model.is_control(i) and not model.is_unknown(i) and not model.is_unused(i):
                plain = piece.replace(SPACE, " ")
                if " " not in plain.lstrip(" "):  # a piece that spans two words is never used
                    self.pieces[plain] = (i, model.get_score(i))
                    self.text[i] = plain.encode()
        self.longest = max(map(len, self.pieces))
        #: Every beginning of a piece, with the piece where it is one.
        self.table: dict[str, tuple[int, float] | None] = {p[:i]: None for p in self.pieces for i in range(1, len(p))} | self.pieces
        letters = [p for p in self.pieces if any(a.isalpha() and not b.isalnum() and b != " " for a, b in zip(p, p[1:]))]
        #: Whether a word may be cut between a letter and a punctuation mark without losing a piece.
        self.cuts_marks = not letters

    def edges(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each end, the (start, ids, score) of the pieces that end there."""
        n, out = len(word), [[] for _ in range(len(word) + 1)]
        pieces = self.pieces
        for end in range(1, n + 1):
            here = out[end]
            for start in range(max(0, end - self.longest), end):
                found = pieces.get(word[start:end])
                if found:
                    here.append((start, (found[0],), found[1]))
            if word[end - 1 : end] not in pieces:
                raw = word[end - 1].encode("utf-8", "replace")
                here.append((end - 1, tuple(self.byte[b] for b in raw), self.byte_score * len(raw)))
        return out

    def forward(self, edges: list) -> np.ndarray | list[float]:
        """Best score of a path from the start to each place."""
        best = [0.0] + [0.0] * (len(edges) - 1)
        for end in range(1, len(edges)):
            best[end] = max(best[start] + score for start, _, score in edges[end])
        return best

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids), best first: A-star from the end, with the forward scores ahead."""
        edges = self.edges(word)
        ahead = self.forward(edges)
        order, out = 0, []
        # Of equal scores the path nearest the start goes on, so ties never fan out.
        heap = [(-ahead[-1], len(word), order, 0.0, None)]
        while heap and len(out) < n:
            _, at, _, behind, rest = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while rest:
                    ids.extend(rest[0])
                    rest = rest[1]
                out.append((behind, tuple(ids)))
                continue
            for start, piece, score in edges[at]:
                order += 1
                heapq.heappush(heap, (round(-(ahead[start] + score + behind), 6), start, order, behind + score, (piece, rest)))
        return out

    def best_and_loss(self, word: str) -> tuple[float, tuple[int, ...], float]:
        """(best score, its ids, what the second best loses), by Viterbi from both ends.

        The second best leaves the best path at some edge, so it is the best path through an edge
        that is not on it; infinite loss without one.
        """
        get, n = self.table.get, len(word)
        ahead, back, edges = [0.0] + [-1e300] * n, [None] * (n + 1), []
        for start in range(n):
            base = ahead[start]
            for end in range(start + 1, n + 1):
                found = get(word[start:end], 0)
                if found:
                    edge = (start, end, found[1], found[0])
                elif end == start + 1:
                    raw = word[start:end].encode("utf-8", "replace")
                    edge = (start, end, self.byte_score * len(raw), tuple(self.byte[b] for b in raw))
                elif found is None:
                    continue
                else:
                    break
                edges.append(edge)
                score = base + edge[2]
                if score > ahead[end]:
                    ahead[end], back[end] = score, edge
                if found == 0:  # no piece begins so
                    break
        ids, on, at = [], set(), n
        while at:
            edge = back[at]
            on.add((edge[0], at))
            ids.append(edge[3])
            at = edge[0]
        behind = [-1e300] * n + [0.0]
        second = -1e300
        for start, end, score, _ in reversed(edges):
            rest = score + behind[end]
            if rest > behind[start]:
                behind[start] = rest
        for start, end, score, _ in edges:
            if (start, end) not in on:
                through = ahead[start] + score + behind[end]
                if through > second:
                    second = through
        flat = []
        for x in reversed(ids):
            flat.extend(x) if isinstance(x, tuple) else flat.append(x)
        return ahead[n], tuple(flat), ahead[n] - second if second > -1e299 else np.inf

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """What a sequence of ids stands for."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; the space put before a text is taken off."""
        return self.bytes_of(np.asarray(ids)).decode("utf-8", "replace")[1:]


class Memo:
    """Best ids, score and loss of the second best of the words seen so far, as sorted arrays."""

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.listed: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.ids = np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        size, score, loss, ids = [], [], [], []
        for word in words:
            top, best, lost = self.lattice.best_and_loss(word)
            size.append(len(best))
            score.append(top)
            loss.append(lost)
            ids.extend(best)
        place = np.searchsorted(self.known, keys)
        at = len(self.ids) + np.cumsum(size, dtype=np.int64) - np.array(size, np.int64)
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
        for name, values in (("at", at), ("size", size), ("score", score), ("loss", loss)):
            setattr(self, name, np.insert(getattr(self, name), place, values))
        self.known = np.insert(self.known, place, keys)

    def variants(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best of a word; those of few words are kept."""
        found = self.listed.get(word)
        if found is None or len(found) < n:
            if len(self.listed) >= LISTED:
                self.listed.clear()
            found = self.listed[word] = self.lattice.n_best(word, n)
        return found


_MEMOS: dict[str, Memo] = {}


def _memo(path: str) -> Memo:
    if path not in _MEMOS:
        _MEMOS[path] = Memo(Lattice(path))
    return _MEMOS[path]


_NO_SPACE = np.zeros(256, bool)


def _boundaries(cuts_marks: bool):
    """Bytes at which a word begins: a space after another character, and marks after letters."""

    def cut(text: np.ndarray) -> np.ndarray:
        begins = np.zeros(len(text), bool)
        begins[1:] = (text[1:] == 32) & (text[:-1] != 32)
        if cuts_marks:
            letter = ((text | 32) >= 97) & ((text | 32) <= 122)
            mark = (text > 32) & (text < 127) & ~letter & ~((text >= 48) & (text <= 57))
            begins[1:] |= letter[:-1] & mark[1:]
        return begins

    return cut


def _with_space(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before each, and their offsets."""
    lengths = np.diff(offs)
    text = np.insert(data[offs[0] : offs[-1]], offs[:-1] - offs[0], 32)
    return text, np.r_[0, np.cumsum(lengths + 1)]


def _choices(found: list[list[tuple[float, tuple[int, ...]]]], total: float, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """(score, variant of each word) of a text's n best segmentations, from the n best of its words of least loss."""
    best = [(total, ())]
    for variants in found:
        best = heapq.nlargest(n, ((a + s - variants[0][0], (*chosen, v)) for a, chosen in best for v, (s, _) in enumerate(variants)))
    return best


def _segmented(path: str, n: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        lattice = memo.lattice
        cut = _boundaries(lattice.cuts_marks)
        for batch in batches:
            data, offs = tx.column_bytes(batch.column(1))
            docs = tx.id_values(batch.column(0))
            for a, b in tx.slices(offs):
                text, rows = _with_space(data, offs[a : b + 1])
                words = tx.Words(text, rows, lower=False, space=_NO_SPACE, cut=cut)
                uniq, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
                if len(memo.known) > REMEMBERED:
                    memo.forget()
                raw = words.text.tobytes()
                text_of = lambda w: raw[words.starts[w] : words.ends[w]].decode("utf-8", "replace")
                new = np.flatnonzero(~np.isin(uniq, memo.known, assume_unique=True))
                if len(new):
                    memo.learn(uniq[new], [text_of(w) for w in first[new]])
                place = np.searchsorted(memo.known, uniq)[inverse]
                size = memo.size[place]
                ids = memo.ids[tx.ranges(memo.at[place], size)]
                count = np.bincount(words.row, size, b - a).astype(np.int64)
                total = np.bincount(words.row, memo.score[place], b - a)
                begin = np.searchsorted(words.row, np.arange(b - a + 1))
                word_at = np.cumsum(size) - size
                ends = np.cumsum(count)
                columns: list[list] = [[] for _ in range(5)]
                segmentations: list[list[np.ndarray]] = []
                for i in range(b - a):
                    own = ids[ends[i] - count[i] : ends[i]]
                    loss = memo.loss[place[begin[i] : begin[i + 1]]]
                    few = np.argpartition(loss, n - 1)[: n - 1] if len(loss) > n - 1 else np.arange(len(loss))
                    few = np.sort(few[np.isfinite(loss[few])]) + begin[i]
                    found = [memo.variants(text_of(w), n) for w in few.tolist()]
                    cuts = [(int(word_at[w] - ends[i] + count[i]), int(size[w])) for w in few.tolist()]
                    lists = []
                    scored = _choices(found, float(total[i]), n)
                    for _, chosen in scored:
                        parts, at = [], 0
                        for (start, width), variants, v in zip(cuts, found, chosen):
                            if v:
                                parts += [own[at:start], np.array(variants[v][1], np.int32)]
                                at = start + width
                        lists.append(np.concatenate([*parts, own[at:]]) if parts else own)
                    whole = raw[rows[i] : rows[i + 1]]
                    for c, value in zip(columns, (len(own), [s for s, _ in scored], [len(x) for x in lists], [zlib.crc32(x.astype("<u4").tobytes()) for x in lists], all(lattice.bytes_of(x) == whole for x in lists))):
                        c.append(value)
                    segmentations.append(lists)
                kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.list_(pa.int32()))]
                arrays = [pa.array(docs[a:b], pa.int64()), *(pa.array(c, k) for c, k in zip([*columns, *([segmentations] if with_ids else [])], kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pieces", "scores", "sizes", "crc32s", "round_trip", "segmentations"][: len(arrays)])
        tx.give_back()

    return run


def encode(docs: DataFrame, model_path: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, n_pieces, scores, sizes, crc32s, round_trip[, segmentations, ids])``, one row per document.

    ``segmentations`` are the n best lists of ids by total piece score of the whole text, best first
    (fewer where a text has fewer), ``ids`` is the first; ``scores``, ``sizes`` and ``crc32s`` are the
    total, the number of ids and the crc32 of the little-endian unsigned ids of each. Characters without a piece
    become byte pieces, so decoding any of the lists gives the text back; ``round_trip`` says that all
    of them do. Null and empty texts are the space that precedes every text. Null and repeated ids are
    kept, other columns ignored; an empty table gives an empty one.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, n_pieces long, scores array<double>, sizes array<long>, crc32s array<long>, round_trip boolean"
    found = d.mapInArrow(_segmented(model_path, n, with_ids), kinds + ", segmentations array<array<int>>" * with_ids)
    found = found.withColumn("doc_id", F.nullif("doc_id", F.lit(tx.NO_ID)))
    return found.withColumn("ids", F.get("segmentations", F.lit(0))) if with_ids else found


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text``: the text of each row's ids; null ids give null."""
    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        lattice = _memo(model_path).lattice
        return ids.map(lambda x: None if x is None else lattice.decode(x))

    return encoded.withColumn("text", text(ids_col))
