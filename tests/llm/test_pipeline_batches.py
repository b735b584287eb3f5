"""The pipeline's stages read rows in batches that are bounded by bytes, and keep the same rows with any batch."""

from __future__ import annotations

import pyarrow as pa
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def batches(spark):
    before = spark.conf.get(KEY)
    yield
    spark.conf.set(KEY, before)


def test_batches_are_bounded(spark, batches):
    """Texts of 20 kB: ten thousand of them in a batch would take 200 MB a task."""

    def sizes(found):
        for b in found:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    spark.conf.set(KEY, "64m")
    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 2500) AS text")
    corpus_pipeline.near_dedup(spark, docs.limit(3), SF)
    n = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(n) > 30 << 20 and max(n) < 5 << 20


def test_batches_change_nothing(spark, batches, monkeypatch):
    """Every stage keeps the same rows with tiny batches."""
    seen = {}
    for size in ("64m", "20k"):
        monkeypatch.setattr(corpus_pipeline, "BATCH_BYTES", size)
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, SF)
            seen.setdefault(name, []).append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert all(a == b and a for a, b in seen.values())
