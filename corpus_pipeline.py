"""Corpus pipeline: quality filter, exact and near de-duplication, secret redaction, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and is written
and read again before the next. All but the last return the columns of ``documents``, other columns
of whatever name included. A null text counts as empty and stays null; rows without an id, and rows
whose id repeats with other texts, are never dropped for another row's sake; an empty table gives an
empty one at every stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import bloom_dedup, bm25_packing, nbsvm, ngram_jaccard, randomness
from corpusq.llm.queries import tokenizer_path
from corpusq.llm.scratch import materialize

#: Documents with a lower quality score go.
LEAST_SCORE = 0.3
#: Words of a shingle and least Jaccard similarity, in per cent, of near copies.
SHINGLE, PERCENT = 5, 80
#: Bytes of a batch of rows between an executor and its Python workers; each running task holds a few batches on either side.
BATCH_BYTES = "4m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """``stage`` with batches that are bounded by bytes: ten thousand whole texts are of any size."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = nbsvm.train(docs.select("doc_id", "text"), labels, ~nbsvm.held_out())
    scored = nbsvm.score(docs, model, out="_quality_score")
    return scored.where(F.col("_quality_score") >= LEAST_SCORE).drop("_quality_score")


@_in_small_batches
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest and first."""
    return bloom_dedup.keep_first_copies(docs)


@_in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id. Rows of repeated ids stay, as an id would not tell which to drop."""
    found = ngram_jaccard.jaccard_components(docs, k=SHINGLE, percent=PERCENT)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    gone = found.where("doc_id <> component_id").select("doc_id").join(repeated, "doc_id", "left_anti")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_in_small_batches
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark and the length counted anew."""
    return randomness.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


@_in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training windows."""
    return bm25_packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("secret scans", secrets),
    ("packing", packing),
]

#: The stages learn, link and pack in ways that SQL does not express; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
