"""Incremental enrichment of note tables that arrive as files, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..operators import enrich as E
from ..operators import state as S
from ..plans.store import Store
from ..session import stash

NOTES = "path string, content string"


def newest(batch: DataFrame) -> DataFrame:
    """One row for each path of a batch; of several the greatest content stays, as files have no order
    among each other."""
    return batch.groupBy("path").agg(F.max("content").alias("content"))


def process_batch(batch: DataFrame, store: Store, enricher: E.Enricher) -> int:
    """Enriches the changed notes of a batch and commits; repeating a batch changes nothing, because
    unchanged hashes are skipped."""
    notes = newest(batch).withColumn("content_hash", content_hash(F.col("content")))
    now = store.load()
    todo = stash(S.changed(notes, now.states), "stream-todo")
    replies = stash(E.enriched(todo, enricher), "stream-replies")
    parsed = E.parsed_replies(replies).where("ok")
    parsed = stash(parsed.withColumn("seq", F.monotonically_increasing_id()), "stream-parsed")
    if not parsed.take(1):
        return 0
    store.append(S.processed(S.placed(parsed, now.states)))
    return parsed.count()


def follow(spark: SparkSession, source: str, store: Store, checkpoint: str, enricher: E.Enricher | None = None) -> StreamingQuery:
    """Processes all Parquet files of notes in source that are new since the last call, then stops."""
    client = enricher or E.FrequentWords()
    stream = spark.readStream.schema(NOTES).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda batch, _: process_batch(batch, store, client) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
