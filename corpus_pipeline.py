"""The corpus pipeline: what each stage keeps goes on to the next, and the last packs it.

Every stage but the last returns the columns of documents. A stage's result is written and read again
before the next begins; tables that a stage itself wrote on the way are deleted when a later one
starts.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import exact, near, packing, quality, suffix
from marginalia.llm.common import documents
from marginalia.session import drop_paths, prepare, recording, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with a lower quality score go.
LEAST_QUALITY = 0.7

#: Tables that the stages of this thread's run left.
_run = threading.local()


def stage(build: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        read = docs.inputFiles()
        left = getattr(_run, "left", [])
        done = [path for path in left if not any(path in file for file in read)]
        drop_paths(spark, done)
        with recording() as paths:
            out = build(spark, docs, sf_dir)
        _run.left = [path for path in left if path not in done] + paths
        return out

    run_stage.__name__, run_stage.__doc__ = build.__name__, build.__doc__
    return run_stage


@stage
def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nearest-neighbour voting: documents that it rejects go."""
    model = quality.fit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return quality.quality_scores(docs, model, carry=COLUMNS).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of texts that differ in white space at most."""
    return exact.exact_dedup(docs).select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by shingles of five words at a similarity of 0.8."""
    return near.near_dedup(docs).select(*COLUMNS)


@stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds go; the rest of the text stays."""
    cut = suffix.repeated_spans(docs.select(*COLUMNS), cut_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", classify_quality),
    ("exact-dedup", exact_dedup),
    ("near-dedup", near_dedup),
    ("suffix-dedup", suffix_dedup),
    ("packing", pack),
]

#: No SQL can express the stages; tests/llm holds their operators, not the chain, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stash(step(spark, docs, sf_dir), f"stage-{name}")
    return docs
