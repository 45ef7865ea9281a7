"""Feed of new and changed notes, for whoever enriches or indexes only what moved.

    python -m jobs.note_feed --input TABLES --output FEED --checkpoint PROGRESS --config jobs/note_feed.json

A file stream takes the files of documents that came since the last call, some at a time, and stops. A note
goes into the feed if its path is new or its hash differs from the last one in the feed, with its tags,
links and sizes. The feed is Parquet, partitioned by batch and language; a batch that is run again, after
a crash, replaces its own partitions with the same rows.
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.tags import frequent_words
from marginalia.functions.text import frontmatter, outgoing_links
from marginalia.session import stash, unstash

from .common import DOCUMENTS, command_line, log, notes_of, rows_read, settings

DEFAULTS = {"pattern": "documents*.parquet", "files_per_batch": 1000, "most_tags": 6, "files_per_language": 8}
FEED = (
    "batch long, lang string, path string, content_hash string, status string, n_words long, tags array<string>, "
    "links array<string>, fields map<string,string>"
)


def newest(rows: DataFrame) -> DataFrame:
    """(path, modified, content_hash): of each path the file that changed last, of several the greatest hash."""
    return rows.groupBy("path").agg(F.max(F.struct("modified", "content_hash")).alias("mark")).select("path", "mark.*")


def read_feed(spark: SparkSession, target: str) -> DataFrame:
    """The feed as it stands; without rows as long as nothing was written."""
    try:
        return spark.read.schema(FEED).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FEED)


def last_hashes(feed: DataFrame, batch: int) -> DataFrame:
    """(path, last): the hash of each path in the feed before a batch."""
    earlier = feed.where(F.col("batch") < batch)
    return earlier.groupBy("path").agg(F.max_by("content_hash", "batch").alias("last"))


def changed_notes(notes: DataFrame, last: DataFrame | None) -> DataFrame:
    """The notes that are new or differ, with status new or changed."""
    if last is None:
        return notes.withColumn("status", F.lit("new"))
    rows = notes.join(last, "path", "left").where(~F.col("content_hash").eqNullSafe(F.col("last")))
    return rows.withColumn("status", F.when(F.col("last").isNull(), "new").otherwise("changed")).drop("last")


def enriched(notes: DataFrame, most_tags: int) -> DataFrame:
    """Notes with what the feed says of them, all of it worked out in the note's row; their text stays behind."""
    content = F.col("content")
    words = F.size(F.filter(F.split(content, r"\s+"), lambda w: w != ""))
    return notes.select(
        "lang",
        "path",
        "content_hash",
        "status",
        words.cast("long").alias("n_words"),
        frequent_words(content, most_tags).alias("tags"),
        outgoing_links(content).alias("links"),
        frontmatter(content).alias("fields"),
    )


def with_texts(marks: DataFrame, rows: DataFrame, most_tags: int) -> DataFrame:
    """The feed's rows for marks (path, modified, content_hash, status), each once, out of all rows of the batch.
    Tables are built of marks; texts run past them and are never sorted or held, and of rows with the same
    mark one stays once their texts are gone."""
    keys = marks.select("path", F.struct("modified", "content_hash").alias("mark"), "status")
    met = rows.join(keys.hint("shuffle_hash"), "path").where(F.struct("modified", "content_hash") == F.col("mark"))
    found = enriched(met, most_tags)
    others = [c for c in found.columns if c != "path"]
    return found.groupBy("path").agg(F.first(F.struct(*others)).alias("note")).select("path", "note.*")


def note_feed(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Takes what is new in the documents files of source into the feed in target; returns the counts of
    rows read, rows without an id (they are left out) and notes written, and of batches."""
    use = settings(DEFAULTS, config)
    total = {"batches": 0, "read": 0, "without_id": 0, "written": 0}

    def take(batch: DataFrame, number: int) -> None:
        session, read = batch.sparkSession, rows_read(batch)
        rows = notes_of(batch, "modified").where("path IS NOT NULL")
        last = last_hashes(read_feed(session, target), number) if number else None
        moved = stash(changed_notes(newest(rows), last), "feed-marks")
        out = with_texts(moved, rows, use["most_tags"]).withColumn("batch", F.lit(number).cast("long"))
        spread = F.pmod(F.xxhash64("path"), F.lit(use["files_per_language"]))
        dealt = out.repartition("lang", spread)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(target)
        found = read | {"written": moved.count(), "batches": 1}
        unstash(moved)
        log.info("batch %d: read %d rows (%d without an id), wrote %d notes to %s", number, found["read"], found["without_id"], found["written"], target)
        for name, n in found.items():
            total[name] += n

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", use["files_per_batch"]).parquet(f"{source}/{use['pattern']}")
    stream = stream.withColumn("modified", F.col("_metadata.file_modification_time"))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %d batches from %s", total["batches"], source)
    return total


if __name__ == "__main__":
    command_line(__doc__.splitlines()[0], note_feed, checkpoint=True)
