"""Packing into training windows by lexical retrieval.

1. ``_tokenised`` encodes every text once and counts each term's document frequency over all rows.
2. ``_telling_terms`` names, for each text, its terms of greatest BM25 weight. Rows are dealt to
   partitions and sorted by them, so texts about the same things lie together wherever they came
   from; a group of texts with the same terms is split by a hash of its rows.
3. ``_packed`` cuts the sorted rows into shards of bounded size and builds a BM25 inverted index over
   the whole texts of each shard, with the frequencies of the corpus. A seed document asks the index,
   with all its terms, for its unused neighbours, which greedily fill the seed's window; a neighbour
   that does not fit is cut, and its rest stays available.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm import textops as tx
from corpusq.llm.scratch import discard, materialize

WINDOW, END_ID = 4096, 2
#: A shard holds at most so many tokens (a longer text stands alone); tokens that a partition aims at.
SHARD_TOKENS, PARTITION_TOKENS = 1 << 19, 1 << 25
#: BM25 constants; neighbours taken at once; terms by which rows are dealt.
K1, B, NEIGHBOURS, DEALT_BY = 1.2, 0.75, 48, 3
#: Words whose ids a worker remembers; ids are stored in two bytes, and so are the times of a term in a text: what is
#: over MOST_TIMES stands in further entries of the term.
REMEMBERED, MOST_IDS, MOST_TIMES = 600_000, 1 << 16, 65_535
#: Stands between new words that are encoded as one string, and words in such a string.
BETWEEN, TOGETHER = "\x01", 200


class WordTokenizer:
    """Ids of whole texts by way of remembered ids of their words.

    For tokenizers that drop white space and never let a token cross it. A word may also end between
    a letter and a punctuation mark other than an apostrophe, unless a text holds ``<|``, with which
    special tokens begin. Where the tokenizer lower-cases, words that differ in A-Z alone are one word.
    New words are encoded many at a time with BETWEEN among them, where that is a token of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > MOST_IDS:
            raise ValueError(f"{path}: over {MOST_IDS} ids, which two bytes do not hold")
        plain = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        mark, normalizer = plain(BETWEEN), self.tokenizer.normalizer
        self.between = mark[0] if len(mark) == 1 and plain(f"a {BETWEEN} b") == [*plain("a"), *mark, *plain("b")] else None
        self.lowers = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    @staticmethod
    def _cut(text: np.ndarray) -> np.ndarray:
        begins = np.zeros(len(text), bool)
        if len(text) < 2 or ((text[:-1] == 60) & (text[1:] == 124)).any():
            return begins
        letter = ((text | 32) >= 97) & ((text | 32) <= 122)
        letter[1:] |= (text[:-1] == 0xC3) & (text[1:] != 0x97) & (text[1:] != 0xB7)
        mark = (text > 32) & (text < 127) & ~letter & ~((text >= 48) & (text <= 57)) & (text != 39)
        begins[1:] = letter[:-1] & mark[1:]
        return begins

    @staticmethod
    def _lowered(text: np.ndarray) -> np.ndarray:
        """``text`` with a-z for A-Z, but for letters before a character that might join them to one (only ASCII and U+00C0 to U+00FF never do), and texts with ``<|``."""
        capital = (text >= 65) & (text <= 90)
        capital[:-1] &= (text[1:] < 128) | (text[1:] == 0xC3)
        if ((text[:-1] == 60) & (text[1:] == 124)).any():
            return text
        return text + (capital.astype(np.uint8) << 5)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of some words."""
        alone = [i for i, w in enumerate(words) if self.between is None or BETWEEN in w or "<|" in w]
        encode = lambda texts: [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if alone:
            apart = set(alone)
            rest = [i for i in range(len(words)) if i not in apart]
            some, n = self._ids_of([words[i] for i in rest]) if rest else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
            parts = dict(zip(rest, np.split(some, np.cumsum(n)[:-1]))) | dict(zip(alone, encode([words[i] for i in alone])))
            got = [parts[i] for i in range(len(words))]
            return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
        flat = np.concatenate(encode([f" {BETWEEN} ".join(words[i : i + TOGETHER]) + f" {BETWEEN}" for i in range(0, len(words), TOGETHER)]))
        ends = np.flatnonzero(flat == self.between)
        return flat[flat != self.between], np.diff(ends, prepend=-1) - 1

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per row) of the rows of one slice."""
        data, offs = data[int(offs[0]) : int(offs[-1])], offs - offs[0]
        words = tx.Words(self._lowered(data) if self.lowers else data, offs, lower=False, cut=self._cut)
        uniq, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, uniq)
        found = np.zeros(len(uniq), bool)
        inside = place < len(self.known)
        found[inside] = self.known[place[inside]] == uniq[inside]
        if not found.all():
            if len(self.known) > REMEMBERED:
                self.forget()
                return self.encode(data, offs)
            raw = words.text.tobytes()
            new = np.flatnonzero(~found)
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())]
            got, size = self._ids_of(texts)
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, got])
            self.known = np.insert(self.known, place[new], uniq[new])
            self.at = np.insert(self.at, place[new], at)
            self.size = np.insert(self.size, place[new], size)
            place = np.searchsorted(self.known, uniq)
        size = self.size[place][inverse]
        ids = self.ids[tx.ranges(self.at[place][inverse], size)]
        return ids, np.bincount(words.row, size, len(offs) - 1).astype(np.int64)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Corpus:
    """Counts over all rows: documents, tokens, and documents of each term; its size is that of the vocabulary."""

    def __init__(self, docs: int, tokens: int, df: np.ndarray):
        self.docs, self.mean = docs, tokens / max(1, docs)
        self.df = df
        self.idf = np.log1p((docs - df + 0.5) / (df + 0.5))

    def weights(self, terms: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """BM25 weights of postings, ``lengths`` being those of their documents."""
        norm = K1 * (1 - B + B * lengths / max(1.0, self.mean))
        return self.idf[terms] * times * (K1 + 1) / (times + norm)


def _vectors(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, times, terms per row) of the rows' token lists."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    key, times = np.unique(row * MOST_IDS + ids, return_counts=True)
    return (key % MOST_IDS).astype(np.uint16), times, np.bincount(key // MOST_IDS, minlength=len(sizes))


def _entries(terms: np.ndarray, times: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' vectors with times of two bytes; a term has an entry for every MOST_TIMES of its times and one for the rest."""
    if times.max(initial=0) <= MOST_TIMES:
        return terms, times.astype(np.uint16), counts
    more = (times - 1) // MOST_TIMES
    row = np.repeat(np.repeat(np.arange(len(counts)), counts), more + 1)
    out = np.full(len(row), MOST_TIMES, np.uint16)
    out[np.cumsum(more + 1) - 1] = times - more * MOST_TIMES
    return np.repeat(terms, more + 1), out, np.bincount(row, minlength=len(counts))


def _from_entries(terms: np.ndarray, times: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors that ``_entries`` was given."""
    if times.max(initial=0) < MOST_TIMES:
        return terms, times, counts
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.ones(len(terms), bool)
    first[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
    if first.all():
        return terms, times, counts
    return terms[first], np.add.reduceat(times.astype(np.int64), np.flatnonzero(first)), np.bincount(row[first], minlength=len(counts))


def _blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The values of each row as bytes, without a copy."""
    ends = np.r_[0, np.cumsum(counts)] * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, values per row) of a column of ``_blobs``."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(offs) else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), np.diff(offs) // np.dtype(kind).itemsize


TOKENISED = "kind int, doc_id long, size long, ids binary, terms binary, times binary, df_terms array<int>, df_docs array<long>"


def _tokenised(path: str):
    """Rows of kind 0, the texts, and one of kind 1 for a task: documents of each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        df, docs, tokens = np.zeros(MOST_IDS, np.int64), 0, 0
        names = [x.split(" ")[0] for x in TOKENISED.split(", ")]
        nothing = lambda n, kind: pa.nulls(n, kind)
        for batch in batches:
            data, offs = tx.column_bytes(batch.column(1))
            ids_of = tx.id_values(batch.column(0))
            for a, b in tx.slices(offs):
                ids, sizes = tokenizer.encode(data, offs[a : b + 1])
                ids = np.insert(ids, np.cumsum(sizes), END_ID)
                sizes = sizes + 1
                terms, times, counts = _vectors(ids, sizes)
                df += np.bincount(terms, minlength=MOST_IDS)
                docs, tokens, n = docs + b - a, tokens + len(ids), b - a
                terms, times, counts = _entries(terms, times, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(ids_of[a:b]), pa.array(sizes), _blobs(ids, sizes), _blobs(terms, counts), _blobs(times, counts), nothing(n, pa.list_(pa.int32())), nothing(n, pa.list_(pa.int64()))], names)
        there = np.flatnonzero(df)
        one = [pa.array([1], pa.int32()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), *(nothing(1, pa.binary()) for _ in range(3)), pa.array([there], pa.list_(pa.int32())), pa.array([df[there]], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(one, names)
        tx.give_back()

    return run


def _corpus(counted: DataFrame) -> Corpus:
    """The sums of the tasks' counts; as many rows reach the driver as the vocabulary has entries."""
    total = counted.agg(F.sum("doc_id"), F.sum("size")).first()
    df = np.zeros(MOST_IDS, np.int64)
    zipped = counted.select(F.explode(F.arrays_zip("df_terms", "df_docs")).alias("x"))
    for r in zipped.groupBy(F.col("x.df_terms").alias("term")).agg(F.sum("x.df_docs").alias("docs")).collect():
        df[r.term] = r.docs
    return Corpus(total[0] or 0, total[1] or 0, df)


def _telling_terms(shared):
    """The terms of greatest weight of each text, the commonest of them first; only terms that other texts hold."""

    @F.pandas_udf("array<int>")
    def found(terms: pd.Series, times: pd.Series, size: pd.Series) -> pd.Series:
        corpus = shared.value
        t, counts = _flat(pa.array(terms, pa.binary()), np.uint16)
        n, _ = _flat(pa.array(times, pa.binary()), np.uint16)
        t, n, counts = _from_entries(t, n, counts)
        row = np.repeat(np.arange(len(counts)), counts)
        weight = np.where((corpus.df[t] > 1) & (t != END_ID), corpus.weights(t, n, size.to_numpy()[row]), 0)
        order = np.lexsort((t, -weight, row))
        place = np.arange(len(t)) - np.repeat(np.cumsum(counts) - counts, counts)
        best = order[place < DEALT_BY]
        best = best[np.lexsort((t[best], -corpus.df[t[best]], row[best]))]
        out = np.full((len(counts), DEALT_BY), -1, np.int32)
        held = np.minimum(counts, DEALT_BY)
        out[row[best], np.arange(len(best)) - np.repeat(np.cumsum(held) - held, held)] = np.where(weight[best] > 0, t[best], -1)
        return pd.Series(list(out))

    return found


class Index:
    """BM25 inverted index over the whole texts of one shard; terms of one text alone are left out."""

    def __init__(self, terms: np.ndarray, times: np.ndarray, counts: np.ndarray, lengths: np.ndarray, corpus: Corpus):
        self.n = len(counts)
        doc = np.repeat(np.arange(self.n), counts)
        shared = np.bincount(terms, minlength=MOST_IDS)[terms] > 1
        terms, times, doc = terms[shared], times[shared], doc[shared]
        weight = corpus.weights(terms, times, lengths[doc]).astype(np.float32)
        order = np.argsort(terms, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.size = np.bincount(terms, minlength=MOST_IDS)
        self.start = np.cumsum(self.size) - self.size
        self.terms, self.doc_start = terms, np.searchsorted(doc, np.arange(self.n + 1))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of all documents of the shard for all terms of ``doc``."""
        terms = self.terms[self.doc_start[doc] : self.doc_start[doc + 1]]
        at = tx.ranges(self.start[terms], self.size[terms])
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(lengths: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Pieces (row, start, length, sequence, offset) of one shard's token lists."""
    pieces, sequence = [], 0
    start = (lengths // WINDOW) * WINDOW
    for row in np.flatnonzero(start):
        for at in range(0, int(start[row]), WINDOW):
            pieces.append((int(row), at, WINDOW, sequence, 0))
            sequence += 1
    left = lengths - start
    unused = left > 0
    order = np.argsort(-left, kind="stable")
    at, filled, open_ = 0, 0, []
    total = int(left.sum())
    while total:
        while not unused[order[at]]:
            at += 1
        room, open_ = WINDOW, []

        def take(row: int) -> None:
            nonlocal room, total
            size = min(room, int(left[row]))
            open_.append((row, int(start[row]), size))
            start[row] += size
            left[row] -= size
            room -= size
            total -= size
            if not left[row]:
                unused[row] = False

        seed = int(order[at])
        take(seed)
        if room and total:
            score = index.scores(seed)
            score[~unused] = -1
            score[seed] = -1 if not unused[seed] else score[seed]
            while room and total:
                few = min(NEIGHBOURS, len(score) - 1)
                best = np.argpartition(-score, few)[: few + 1]
                best = best[score[best] >= 0]
                best = best[np.lexsort((best, -score[best]))]
                if not len(best):
                    break
                for row in best.tolist():  # those that fit
                    if left[row] <= room:
                        take(row)
                        score[row] = -1
                        if not room:
                            break
                rest = best[unused[best]]
                if room and len(rest):  # then the nearest one, cut
                    take(int(rest[0]))
        if room == 0:
            offset = 0
            for row, a, size in open_:
                pieces.append((row, a, size, sequence, offset))
                offset += size
            sequence += 1
            open_ = []
        else:
            break
    return pieces + _halves(open_, sequence)


def _halves(open_: list[tuple[int, int, int]], sequence: int) -> list[tuple[int, int, int, int, int]]:
    """The last window, not full, as sequences whose lengths are powers of two, largest first."""
    out, room, offset = [], 0, 0
    rest = sum(size for *_, size in open_)
    for row, start, size in open_:
        while size:
            if not room:
                room, offset = 1 << (rest.bit_length() - 1), 0
                sequence += 1
            part = min(room, size)
            out.append((row, start, part, sequence - 1, offset))
            start, size, room, offset, rest = start + part, size - part, room - part, offset + part, rest - part
    return out


def _packed(shared, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequence = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, sequence
            if not held:
                return
            docs, sizes, ids, terms, times, counts = (np.concatenate([h[i] for h in held]) for i in range(6))
            held = []
            begin = np.cumsum(sizes) - sizes
            pieces = np.array(pack_shard(sizes, Index(terms, times, counts, sizes, shared.value)), np.int64).reshape(-1, 5)
            row, start, length, number, offset = pieces.T
            parts = [ids[a : a + n].astype("<u4").tobytes() for a, n in zip((begin[row] + start).tolist(), length.tolist())]
            columns = [docs[row], start, length, np.fromiter(map(zlib.crc32, parts), np.int64, len(parts)), sizes[row], base + sequence + number, offset]
            arrays, names = [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            sequence += int(number.max()) + 1 if len(number) else 0
            yield pa.RecordBatch.from_arrays(arrays, names)

        tokens = 0
        for batch in batches:
            docs, sizes = (batch.column(i).to_numpy() for i in (0, 1))
            at = 0
            while at < len(docs):
                room = np.cumsum(sizes[at:])
                end = at + max(int(np.searchsorted(room, SHARD_TOKENS - tokens, "right")), 0 if held else 1)
                if end > at:
                    ids, _ = _flat(batch.column(2)[at:end], np.uint16)
                    terms, counts = _flat(batch.column(3)[at:end], np.uint16)
                    times, _ = _flat(batch.column(4)[at:end], np.uint16)
                    terms, times, counts = _from_entries(terms, times, counts)
                    held.append((docs[at:end], sizes[at:end], ids, terms, times, counts))
                    tokens += int(sizes[at:end].sum())
                if end < len(docs):
                    yield from flush()
                    tokens = 0
                at = end
        yield from flush()
        tx.give_back()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all texts, dealt into sequences of at most WINDOW tokens.

    ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``: every token of a
    text and its end mark END_ID lies in exactly one piece; pieces of a sequence follow each other
    from offset 0. Sequences are full, but for those of a shard's last tokens, whose lengths are
    powers of two. Null and empty texts have the end mark only; null and repeated ids are kept; other
    columns are ignored; an empty table gives an empty one. Neighbours are looked for in the seed's
    shard, to which all rows are dealt by their most telling terms, whatever file they came from.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    rows = materialize(d.mapInArrow(_tokenised(tokenizer_path), TOKENISED), "tokenised", by="kind")
    corpus = _corpus(rows.where("kind = 1"))
    shared = spark.sparkContext.broadcast(corpus)
    tokens = corpus.docs * corpus.mean
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens // SHARD_TOKENS))
    parts = max(1, few, int(tokens // PARTITION_TOKENS))
    texts = rows.where("kind = 0").select("doc_id", "size", "ids", "terms", "times")
    texts = texts.withColumn("by", _telling_terms(shared)("terms", "times", "size")).withColumn("mix", F.xxhash64("doc_id", "ids"))
    dealt = materialize(texts, "dealt")
    discard(rows)
    texts = dealt.repartitionByRange(parts, "by", "mix").sortWithinPartitions("by", "mix", "doc_id")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    found = texts.select("doc_id", "size", "ids", "terms", "times").mapInArrow(_packed(shared, with_ids), kinds)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(tx.NO_ID)))
