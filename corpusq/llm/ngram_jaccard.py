"""N-gram Jaccard join over prefix trees, and the groups that its links form.

How a link is found:

1. ``_shingle_blocks``: every task hashes the shingles of its rows and sends each distinct hash,
   once per chunk of rows, to the range of hashes it falls in, as packed blocks.
2. ``_document_frequency``: a range knows how often each of its hashes occurs in the corpus. Only
   hashes with two or more occurrences go back to their chunks.
3. ``_ordered_sets``: a chunk orders the set of each document globally, rarest hash first. Two sets
   with Jaccard >= t share one of the first n - ceil(t n) + 1 hashes. A document whose first hashes
   all occur once has no partner and ends here.
4. Documents with one set are one class. The classes that share a prefix hash are put in a prefix
   tree (``_trie_pairs``), in the global order; a probe walks it with the overlap so far, shared by
   all sets below a node, and leaves a subtree when overlap plus remaining length can't reach the
   least overlap. A parity sketch, an upper bound for the overlap too, then drops most near misses.
5. The remaining pairs are checked by the exact overlap of their sets.

For components not every link has to be listed. A first walk keeps, for each class of a group, one
partner; a second walk skips pairs that these links already connect, so a large group of near copies
costs edges in proportion to its size, and no link between different components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm import textops as tx
from corpusq.llm.components import connected_components
from corpusq.llm.scratch import materialize

TOKEN_BITS = 48
#: Shingles of one chunk of rows, and about as many of one range of hashes.
CHUNK_SHINGLES = 1 << 20
#: Hashes after the shared one that a tree holds; the bound covers the rest of the set.
TREE_DEPTH = 24
#: Classes under one prefix hash that one group compares; more are dealt over pairs of blocks.
BLOCK = 1024
SKETCH_WORDS = 16
U64 = np.uint64


def _least_common(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-(percent * n) // 100)


def _least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return -(-(percent * (a + b)) // (100 + percent))


def _sketches(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """A parity bitmap for each row: bit i is the parity of its values with hash i."""
    at = (tx.mix(value + U64(77)) >> U64(64 - 10)).astype(np.int64)
    bits = np.bincount(row * (SKETCH_WORDS * 64) + at, minlength=rows * SKETCH_WORDS * 64) & 1
    return np.packbits(bits.astype(np.uint8).reshape(rows, -1), axis=1)


def _shingle_blocks(k: int, bits: int):
    """Rows (kind, part, chunk, body): kind 0 a chunk's rows, kind 1 its hashes in one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk0, seq, held = TaskContext.get().partitionId() << 24, 0, 0
        parts: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, held, parts
            if not parts:
                return
            ids, counts, classes, sketch = (np.concatenate([p[i] for p in parts]) for i in range(4))
            base = np.cumsum([0, *(len(p[0]) for p in parts)])
            doc = np.concatenate([p[4] + b for p, b in zip(parts, base)]).astype(np.uint32)
            token = np.concatenate([p[5] for p in parts]) >> U64(64 - TOKEN_BITS)
            order = np.argsort(token)
            token, doc = token[order], doc[order]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(token)])
            many = times > 1
            place = np.where(many, np.cumsum(many) - 1, 0)
            ref = np.where(many, place * 2 + 1, doc[first].astype(np.int64) * 2).astype(np.uint32)
            chunk, seq = chunk0 + seq, seq + 1
            out = [(0, chunk & ((1 << bits) - 1), chunk, tx.pack(ids, counts, classes.reshape(-1), sketch.reshape(-1), times[many].astype(np.uint32), doc[tx.ranges(first[many], times[many])]))]
            token = token[first]
            cuts = np.searchsorted(token, np.arange(1, 1 << bits, dtype=np.uint64) << U64(TOKEN_BITS - bits))
            for part, (a, b) in enumerate(zip(np.r_[0, cuts], np.r_[cuts, len(token)])):
                if b > a:
                    out.append((1, part, chunk, tx.pack(np.diff(token[a:b], prepend=U64(0)), ref[a:b], times[a:b][many[a:b]].astype(np.uint32))))
            parts, held = [], 0
            kind, part, number, body = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int64()), pa.array(number, pa.int64()), pa.array(body, pa.binary())], ["kind", "part", "chunk", "body"])

        for batch in batches:
            data, offs = tx.column_bytes(batch.column(1))
            ids = tx.id_values(batch.column(0))
            for a, b in tx.slices(offs):
                row, value = tx.distinct(*tx.shingles(tx.Words(data, offs[a : b + 1], lower=True), k))
                n = b - a
                counts = np.bincount(row, minlength=n).astype(np.int32)
                classes = np.zeros((n, 2), np.uint64)
                np.add.at(classes[:, 0], row, tx.mix(value + U64(11)))
                np.add.at(classes[:, 1], row, tx.mix(value ^ U64(0x5851F42D4C957F2D)))
                parts.append((ids[a:b], counts, classes, _sketches(row, value, n), row, value))
                held += len(value) + 8 * n
                if held >= CHUNK_SHINGLES:
                    yield from flush()
        yield from flush()
        tx.give_back()

    return run


def _document_frequency(group: pd.DataFrame) -> pd.DataFrame:
    """Of one range of hashes: for each chunk, those that occur twice or more in the corpus."""
    rows = group[group.kind == 0]
    out = list(zip(rows.kind, rows.part, rows.chunk, rows.body))
    part = int(group.part.iloc[0])
    tokens, refs, times, owner, chunks = [], [], [], [], []
    for chunk, body in group.loc[group.kind == 1, ["chunk", "body"]].itertuples(index=False):
        delta, ref, more = tx.unpack(body)
        t = np.ones(len(ref), np.int64)
        t[(ref & 1) == 1] = more
        tokens.append(np.cumsum(delta, dtype=np.uint64))
        refs.append(ref)
        times.append(t)
        owner.append(np.full(len(ref), len(chunks), np.int64))
        chunks.append(chunk)
    if chunks:
        token, ref, count, own = map(np.concatenate, (tokens, refs, times, owner))
        order = np.argsort(token)
        token, ref, own = token[order], ref[order], own[order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        df = np.repeat(np.add.reduceat(count[order], first), np.diff(np.r_[first, len(token)]))
        keep = df > 1
        token, ref, own, df = token[keep], ref[keep], own[keep], df[keep]
        order = np.argsort(own, kind="stable")
        token, ref, own, df = token[order], ref[order], own[order], df[order]
        cuts = np.searchsorted(own, np.arange(len(chunks) + 1))
        for i, chunk in enumerate(chunks):
            a, b = cuts[i], cuts[i + 1]
            if b > a:
                out.append((1, part, chunk, tx.pack(np.diff(token[a:b], prepend=U64(0)), ref[a:b], np.minimum(df[a:b], 32767).astype(np.uint16))))
    return pd.DataFrame(out, columns=["kind", "part", "chunk", "body"])


def _ordered_sets(percent: int):
    """Of one chunk: rows of kind 0 (documents), 1 (prefix hashes) and 2 (sets with partners)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, counts, classes, sketch, times, listed = tx.unpack(group.loc[group.kind == 0, "body"].iloc[0])
        classes = classes.view(np.uint8).reshape(-1, 16)
        sketch = sketch.reshape(len(ids), -1)
        name = [x.tobytes() for x in classes]
        starts = np.cumsum(times.astype(np.int64)) - times
        docs, keys = [], []
        for body in group.loc[group.kind == 1, "body"]:
            delta, ref, df = tx.unpack(body)
            key = (df.astype(np.uint64) << U64(TOKEN_BITS)) | np.cumsum(delta, dtype=np.uint64)
            one = (ref & 1) == 0
            docs.append((ref[one] >> 1).astype(np.int64))
            keys.append(key[one])
            at = (ref[~one] >> 1).astype(np.int64)
            t = times[at].astype(np.int64)
            docs.append(listed[tx.ranges(starts[at], t)].astype(np.int64))
            keys.append(np.repeat(key[~one], t))
        frames = [pd.DataFrame({"kind": 0, "doc_id": ids, "n": counts, "cls": name})]
        doc = np.concatenate([*docs, np.zeros(0, np.int64)])
        key = np.concatenate([*keys, np.zeros(0, np.uint64)])
        n = counts.astype(np.int64)
        single = n - np.bincount(doc, minlength=len(ids))
        prefix = n - _least_common(n, percent) + 1
        first = np.zeros(len(ids), bool)
        first[list({c: i for i, c in reversed(list(enumerate(name)))}.values())] = True
        active = (n > 0) & (single < prefix) & first
        keep = active[doc]
        doc, key = doc[keep], key[keep]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        begin = np.searchsorted(doc, np.arange(len(ids) + 1))
        place = np.arange(len(doc)) - begin[doc] + np.maximum(single[doc], 0)
        use = place < prefix[doc]
        frames.append(pd.DataFrame({"kind": 1, "n": counts[doc[use]], "cls": [name[i] for i in doc[use]], "token": key[use].astype(np.int64), "place": place[use].astype(np.int32)}))
        there = np.flatnonzero(active)
        frames.append(pd.DataFrame({"kind": 2, "n": counts[there], "cls": [name[i] for i in there], "tokens": [key[begin[i] : begin[i + 1]].astype(np.int64) for i in there], "sketch": [sketch[i].tobytes() for i in there], "place": np.maximum(single[there], 0).astype(np.int32)}))
        out = pd.concat(frames, ignore_index=True)
        for c in ("doc_id", "token", "place"):
            out[c] = out[c].astype("Int64" if c != "place" else "Int32")
        for c in ("tokens", "sketch"):
            out[c] = pd.Series([None if isinstance(x, float) else x for x in out[c]], dtype=object)
        return out[["kind", "doc_id", "n", "cls", "token", "place", "tokens", "sketch"]]

    return run


def _walk(gid: np.ndarray, n: np.ndarray, place: np.ndarray, tail: np.ndarray, sketch: np.ndarray, side: np.ndarray, known: np.ndarray, percent: int, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that pass every bound. Rows must be sorted by (gid, tail).

    A node of depth d is a run of rows of one group with equal first d tail entries. ``side`` 0 and 1
    are the two blocks of a dealt group, of which only pairs of unequal sides count; 2 means all.
    Pairs with equal ``known`` labels are skipped. With ``one``, a row keeps its first partner only.
    """
    m, depth = tail.shape
    rest = n - place - 1
    differs = np.ones((depth + 1, m), bool)
    differs[0, 1:] = gid[1:] != gid[:-1]
    for d in range(1, depth + 1):
        differs[d, 1:] = differs[d - 1, 1:] | (tail[1:, d - 1] != tail[:-1, d - 1])
    begin = [np.flatnonzero(x) for x in differs]
    end = [np.r_[b[1:], m] for b in begin]
    longest = [np.maximum.reduceat(rest, b) - d for d, b in enumerate(begin)]
    least = [np.minimum.reduceat(n, b) for b in begin]
    node_of = np.cumsum(differs[0]) - 1
    sizes = end[0] - begin[0]
    weight = np.cumsum(sizes[node_of])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def check(probe: np.ndarray, row: np.ndarray, overlap: np.ndarray, used: np.ndarray, d: int) -> None:
        ok = row > probe
        probe, row, overlap, used = probe[ok], row[ok], overlap[ok], used[ok]
        need = _least_overlap(n[probe], n[row], percent)
        ok = overlap + np.minimum(np.maximum(rest[probe] - used, 0), np.maximum(rest[row] - d, 0)) >= need
        ok &= ((side[probe] == 2) & (side[row] == 2)) | (side[probe] != side[row])
        ok &= known[probe] != known[row]
        ok &= np.minimum(n[probe], n[row]) * 100 >= np.maximum(n[probe], n[row]) * percent
        probe, row, need = probe[ok], row[ok], need[ok]
        if not len(probe):
            return
        apart = np.bitwise_count(sketch[probe] ^ sketch[row]).sum(1).astype(np.int64)
        ok = apart <= n[probe] + n[row] - 2 * need
        found.append((probe[ok], row[ok]))

    def firsts() -> None:
        """Of what one slice of probes has found: the first partner of each probe, and of each row."""
        probe, row = (np.concatenate([x[i] for x in found[mark:]]) for i in (0, 1))
        order = np.lexsort((row, probe))
        keep = np.zeros(len(probe), bool)
        keep[order[np.r_[True, np.diff(probe[order]) > 0]]] = True
        order = np.lexsort((probe, row))
        keep[order[np.r_[True, np.diff(row[order]) > 0]]] = True
        found[mark:] = [(probe[keep], row[keep])]

    start = 0
    while start < m:
        mark = len(found)
        stop = max(start + 1, int(np.searchsorted(weight, weight[start] - sizes[node_of[start]] + 200_000, "right")))
        probe = np.arange(start, stop)
        node, overlap, used = node_of[start:stop], np.ones(stop - start, np.int64), np.zeros(stop - start, np.int64)
        for d in range(depth + 1):
            last = end[d][node]
            lone = (last - begin[d][node] == 1) | (d == depth)
            size = (last - begin[d][node])[lone]
            if len(size):
                check(np.repeat(probe[lone], size), tx.ranges(begin[d][node[lone]], size), np.repeat(overlap[lone], size), np.repeat(used[lone], size), d)
            if d == depth or lone.all():
                break
            probe, node, overlap, used = probe[~lone], node[~lone], overlap[~lone], used[~lone]
            lo = np.searchsorted(begin[d + 1], begin[d][node])
            many = np.searchsorted(begin[d + 1], end[d][node]) - lo
            child = tx.ranges(lo, many)
            probe, overlap, used = (np.repeat(x, many) for x in (probe, overlap, used))
            ok = end[d + 1][child] > probe + 1
            probe, child, overlap, used = probe[ok], child[ok], overlap[ok], used[ok]
            token = tail[begin[d + 1][child], d]
            own = tail[probe]
            at = (own < token[:, None]).sum(1)
            hit = (at < depth) & (own[np.arange(len(at)), np.minimum(at, depth - 1)] == token) & (token < np.iinfo(np.int64).max)
            # Beyond the entries that the probe holds, a token may be in its set: it counts as if it were.
            maybe = (at == depth) & (np.maximum(used, depth) < rest[probe])
            overlap = overlap + (hit | maybe)
            used = np.minimum(np.maximum(used, at + hit) + maybe, rest[probe])
            need = _least_overlap(n[probe], least[d + 1][child], percent)
            ok = overlap + np.minimum(rest[probe] - used, np.maximum(longest[d + 1][child], 0)) >= need
            probe, node, overlap, used = probe[ok], child[ok], overlap[ok], used[ok]
        if one and len(found) > mark and sum(len(x) for x, _ in found[mark:]):
            firsts()
        start = stop
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _trie_pairs(percent: int, one: bool):
    """Candidate pairs of classes from rows that arrive group by group; see ``_walk`` for ``one``."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        tail = np.full((len(frame), TREE_DEPTH), np.iinfo(np.int64).max)
        for i, x in enumerate(frame.following):
            tail[i, : len(x)] = x
        gid = (frame.token.to_numpy() != frame.token.shift().to_numpy()) | (frame.i.to_numpy() != frame.i.shift().to_numpy()) | (frame.j.to_numpy() != frame.j.shift().to_numpy())
        gid = np.cumsum(gid)
        known = frame.known.to_numpy().astype(np.int64)
        open_ = np.flatnonzero(pd.Series(known).groupby(gid).transform("nunique").to_numpy() > 1)
        frame, tail, gid, known = frame.iloc[open_], tail[open_], gid[open_], known[open_]
        if not len(frame):
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        order = np.lexsort((*tail.T[::-1], gid))
        sketch = np.frombuffer(b"".join(frame.sketch), np.uint64).reshape(len(frame), SKETCH_WORDS)[order]
        cls = frame.class_id.to_numpy()[order]
        side = np.where(frame.i == frame.j, 2, np.where(frame.block == frame.i, 0, 1))[order]
        a, b = _walk(gid[order], frame.n.to_numpy().astype(np.int64)[order], frame.place.to_numpy().astype(np.int64)[order], tail[order], sketch, side, known[order], percent, one)
        return pd.DataFrame({"a": np.minimum(cls[a], cls[b]), "b": np.maximum(cls[a], cls[b])}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            last = frame.iloc[-1]
            same = (frame.token == last.token) & (frame.i == last.i) & (frame.j == last.j)
            held = frame[same]
            if not same.all():
                yield solve(frame[~same].reset_index(drop=True))
        if held is not None and len(held):
            yield solve(held.reset_index(drop=True))
        tx.give_back()

    return run


def _classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, entries): documents with their class, ordered sets, shared prefix hashes."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    chars = d.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(2, min(24, math.ceil(math.log2(max(1, chars / 6 / CHUNK_SHINGLES)))))
    blocks = d.mapInArrow(_shingle_blocks(k, bits), "kind int, part long, chunk long, body binary")
    returned = blocks.groupBy("part").applyInPandas(_document_frequency, blocks.schema)
    sets = returned.groupBy("chunk").applyInPandas(_ordered_sets(percent), "kind int, doc_id long, n int, cls binary, token long, place int, tokens array<long>, sketch binary")
    sets = materialize(sets, "sets", by="kind")
    rows = sets.where("kind = 0 and doc_id is not null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "cls")
    # Written first: both sides of the join are then plain shuffles, of which adaptive execution splits a class with very many rows.
    first = materialize(rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id")), "classes")
    members = rows.where("n_shingles > 0").join(first, "cls").select("doc_id", "n_shingles", "class_id")
    members = materialize(members.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"))), "members")

    prefix = sets.where("kind = 1").select("token", "cls", "n", "place").distinct()
    shared = prefix.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1")
    prefix = prefix.join(shared, "token")
    content = sets.where("kind = 2").select("cls", "n", "tokens", "sketch", F.col("place").alias("single")).dropDuplicates(["cls"])
    content = materialize(content.join(first, "cls"), "content")
    entries = prefix.join(content.drop("n"), "cls").withColumn("blocks", F.ceil(F.col("classes") / F.lit(BLOCK)).cast("int"))
    entries = entries.select("token", "class_id", "n", "place", F.expr(f"slice(tokens, place - single + 2, {TREE_DEPTH})").alias("following"), "sketch", "blocks")
    return members, content.select("class_id", F.col("n").cast("long").alias("n"), "tokens"), materialize(entries, "entries")


def _linked(entries: DataFrame, sets: DataFrame, percent: int, one: bool) -> DataFrame:
    """``(src, dst)`` of the classes that the tree walk pairs and whose exact overlap suffices."""
    e = entries.withColumn("block", F.expr("cast(pmod(xxhash64(class_id), blocks) as int)")).withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
    e = e.select("token", "class_id", "n", "place", "following", "sketch", "known", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    e = e.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    pairs = e.mapInPandas(_trie_pairs(percent, one), "a long, b long").distinct()
    x, y = (sets.select(F.col("class_id").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}")) for c in "ab")
    pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("both"))
    return pairs.where(f"100 * both >= {percent} * (na + nb - both)").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def jaccard_links(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of all texts with Jaccard similarity of word k-shingles >= percent / 100.

    ``members(doc_id, n_shingles, class_id)``: class_id is the smallest id of the documents with the
    same shingle set. ``links(src, dst)``: all pairs of linked classes, by class_id, src < dst. Words
    are maximal runs of other characters than white space, A-Z in lower case; a text of fewer than k
    words has one shingle. Null and empty texts have no shingle, stand alone in a class, and link with
    nothing. Rows without an id are left out, repeated ids give repeated rows, other columns are ignored;
    an empty table gives two empty ones.
    """
    members, sets, entries = _classes(docs, k, percent, id_col, text_col)
    return members, _linked(entries.withColumn("known", F.col("class_id")), sets, percent, one=False)


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_id)``, one row per document.

    component_id is the smallest id that links lead to, the document's own included. The rules for
    texts are those of ``jaccard_links``.
    """
    members, sets, entries = _classes(docs, k, percent, id_col, text_col)
    links = materialize(_linked(entries.withColumn("known", F.col("class_id")), sets, percent, one=True), "links")
    label = connected_components(links).select(F.col("node").alias("class_id"), "component")
    again = entries.join(label, "class_id", "left").withColumn("known", F.coalesce("component", "class_id"))
    across = materialize(_linked(again, sets, percent, one=False), "links")
    # Links across stand between components: those are joined as nodes of their own graph, so the first links are not walked again.
    of = lambda c: label.select(F.col("class_id").alias(c), F.col("component").alias(f"_{c}"))
    between = across.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
    root = connected_components(between).select(F.col("node").alias("_first"), F.col("component").alias("_root"))
    out = members.join(label, "class_id", "left").withColumn("_first", F.coalesce("component", "class_id")).join(root, "_first", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_root", "_first").alias("component_id"), "class_id")
