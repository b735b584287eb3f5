"""Quality classifier: naive Bayes support vectors.

Features are hashed indicators of word 1- and 2-grams and of character 3-grams. Each indicator is
scaled by its class log-count ratio, and a linear hinge-loss model is fitted on the scaled indicators
by dual coordinate descent. A held-back part of the learning rows turns margins into probabilities.
Learning uses a bounded sample of the labelled rows; scoring reads every row once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm import textops as tx

#: Hash buckets of the indicators.
BUCKETS = 1 << 18
#: Most labelled rows that learning uses, taken by hash of the id; features of one text at most.
MOST_ROWS = 12_000
#: Passes of the coordinate descent, its box constraint, and the smoothing of the log-count ratio.
PASSES, COST, SMOOTH = 8, 0.1, 1.0
#: Every fifth learning row fits the probabilities instead of the model.
CALIBRATE = 5
U64 = np.uint64


def indicators(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), distinct and sorted, of the rows of one slice of texts."""
    words = tx.Words(data, offs, lower=False)
    h, row = words.hashes, words.row
    pairs = row[1:] == row[:-1]
    two = tx.mix(h[:-1][pairs] * U64(3) + h[1:][pairs])
    text = words.text.astype(np.uint64)
    n = np.diff(offs)
    at = np.arange(max(0, len(text) - 2))
    text_row = np.repeat(np.arange(len(n)), n)
    inside = text_row[: len(at)] == text_row[2:]
    at = at[inside]
    three = tx.mix((text[at] << U64(16)) | (text[at + 1] << U64(8)) | text[at + 2] | U64(1 << 40))
    bucket = np.concatenate([h, two, three]) >> U64(64 - 18)
    rows = np.concatenate([row, row[1:][pairs], text_row[at]])
    key = np.sort(rows.astype(np.int64) * BUCKETS + bucket.astype(np.int64))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key // BUCKETS, key % BUCKETS


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, held, features) of labelled rows (doc_id, text, label)."""
    for batch in batches:
        data, offs = tx.column_bytes(batch.column(1))
        ids, labels = tx.id_values(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
        for a, b in tx.slices(offs):
            row, bucket = indicators(data, offs[a : b + 1])
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            feats = [bucket[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(labels[a:b], pa.int32()), pa.array(feats, pa.binary())], ["doc_id", "label", "features"])
    tx.give_back()


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the bias last, dual variables, their bounds) of the hinge-loss model on indicators scaled by ``scale``.

    Maximises the dual one coordinate at a time; every row's norm is one after scaling. A row's bound
    is ``cost`` times twenty times the share of the other class, so both classes weigh the same.
    """
    norm = np.array([np.sqrt(float((scale[r] ** 2).sum()) + 1e-12) for r in rows])
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    box = 20 * cost * np.maximum(np.where(y > 0, (y < 0).mean(), (y > 0).mean()), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            s = scale[r] / norm[i]
            gradient = y[i] * (float(w[r] @ s) + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), box[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * s
                bias += step
                alpha[i] = new
    return np.r_[w, bias], alpha, box


def _margins(rows: list[np.ndarray], w: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.array([float(w[r] @ scale[r]) / np.sqrt(float((scale[r] ** 2).sum()) + 1e-12) + w[-1] for r in rows])


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve, by Newton steps on smoothed targets."""
    hi, lo = (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2)
    target = np.where(label == 1, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        v = p * (1 - p)
        hess = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """One row with the packed model, from the whole (bounded) sample."""
    group = group.sort_values(["doc_id", "features", "label"])
    rows = [np.frombuffer(x, np.int32) for x in group.features]
    label = group.label.to_numpy().astype(np.int64)
    back = np.arange(len(rows)) % CALIBRATE == 0
    seen = np.zeros((2, BUCKETS))
    for r, c, out in zip(rows, label, back):
        if not out:
            seen[c, r] += 1
    one, zero = seen[1] + SMOOTH, seen[0] + SMOOTH
    scale = np.log((one / one.sum()) / (zero / zero.sum()))
    fit = [r for r, out in zip(rows, back) if not out]
    y = np.where(label[~back] == 1, 1.0, -1.0)
    w, _, _ = dual_coordinate_descent(fit, y, scale)
    a, b = _calibrate(_margins([r for r, out in zip(rows, back) if out], w, scale), label[back]) if back.sum() > 1 else (1.0, 0.0)
    return pd.DataFrame({"model": [tx.pack(w.astype(np.float32), scale.astype(np.float32), np.array([a, b]))]})


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", most_rows: int = MOST_ROWS) -> bytes | None:
    """A packed model from the labelled rows that ``usable`` (on doc_id) allows; None without any.

    ``most_rows`` bounds the sample, labels and texts: both are taken in the order of a hash of their ids. The ids of
    the sample, at most ``most_rows`` longs, are sent to the tasks that read ``docs``; texts that
    carry no label never move. Labels other than 0 and 1, and null ids, are left out; of several labels of
    one id the least counts, and the texts of a repeated id carry it.
    """
    rows = labels.where(usable & F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("label"))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    features = joined.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "label").mapInArrow(_featured, "doc_id long, label int, features binary")
    # Texts of repeated ids share a label: their rows are bounded too, by the order of the ids and then of the features.
    features = features.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(most_rows)
    found = features.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_fit, "model binary").collect()  # one row, two vectors of BUCKETS floats
    return bytes(found[0].model) if found else None


def score(docs: DataFrame, model: bytes | None, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` in [0, 1]; every whole text is read, null as empty.

    Without a model every score is 0.5. An input column named ``out`` is replaced; all others stay.
    """
    docs = docs.drop(out)
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, scale, (a, b) = tx.unpack(shared.value)
        weight, square, bias = (w[:-1] * scale).astype(np.float64), scale.astype(np.float64) ** 2, float(w[-1])
        for batch in batches:
            data, offs = tx.column_bytes(batch.column(at))
            margin = np.zeros(batch.num_rows)
            for lo, hi in tx.slices(offs):
                row, bucket = indicators(data, offs[lo : hi + 1])
                top = np.bincount(row, weight[bucket], hi - lo)
                margin[lo:hi] = top / np.sqrt(np.bincount(row, square[bucket], hi - lo) + 1e-12) + bias
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, out])
        tx.give_back()

    at = docs.columns.index(text_col)
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, `{out}` double")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5: such rows are never learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
