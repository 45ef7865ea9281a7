"""Report of related notes: merged tags of every note, and the notes that share most of them.

    python -m jobs.related_notes --input TABLES --output REPORT --config jobs/related_notes.json

Tags that are forms of each other are merged over the whole vault first. Two notes are related if they share
enough merged tags and neither links to the other yet, on however many notes the tags are. The report is
Parquet, partitioned by language; a run replaces the whole report, so that it is the same however often it
is run.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.tags import frequent_words
from marginalia.operators import links as L
from marginalia.operators import tags as T
from marginalia.session import stash, unstash

from .common import DOCUMENTS, command_line, log, notes_of, rows_read, settings

DEFAULTS = {"most_tags": 6, "threshold": 2, "min_shared": 2, "most_related": 5, "files_per_language": 8}
REPORT = "lang string, path string, tags array<string>, n_merged long, related array<struct<path:string,n_shared:long>>"


def related(states: DataFrame, notes: DataFrame, min_shared: int, most: int) -> DataFrame:
    """(path, related): for each note the notes it shares most tags with, ties by path, without those that a link
    in a text already joins."""
    best = T.most_shared(T.tag_index(states), L.linked_pairs(notes), most, min_shared)
    entries = F.array_sort(F.collect_list(F.struct("place", F.struct(F.col("other").alias("path"), "n_shared").alias("note"))))
    return best.groupBy("path").agg(F.transform(entries, lambda x: x["note"]).alias("related"))


def related_notes(spark: SparkSession, source: str, target: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Writes the report on the documents in source to target; returns the counts of rows read, rows without an
    id (they are left out), notes written, notes with merged tags and with related notes. Of rows with the
    same path that with the greatest hash is the note."""
    use = settings(DEFAULTS, config)
    docs = spark.read.schema(DOCUMENTS).parquet(f"{source}/documents.parquet")
    rows = notes_of(docs, "doc_id").where("path IS NOT NULL")
    rows = rows.groupBy("path").agg(F.max_by(F.struct("lang", "content", "doc_id"), "content_hash").alias("note"))
    notes = stash(rows.select("path", "note.*"), "report-notes")
    tags = frequent_words(F.col("content"), use["most_tags"]).alias("proposed_tags")
    states = stash(notes.select("path", "lang", F.col("doc_id").alias("ord"), tags), "report-states")
    mapping = stash(T.normalization_map(T.tag_counts(states), use["threshold"]), "report-map")
    merged = stash(T.normalized(states, mapping), "report-merged")
    others = stash(related(merged, notes, use["min_shared"], use["most_related"]), "report-related")
    empty = "array<struct<path:string,n_shared:long>>"
    report = merged.join(others, "path", "left").select(
        "lang",
        "path",
        F.coalesce("proposed_tags", F.array().cast("array<string>")).alias("tags"),
        F.col("replaced").cast("long").alias("n_merged"),
        F.coalesce("related", F.array().cast(empty)).alias("related"),
    )
    spread = F.pmod(F.xxhash64("path"), F.lit(use["files_per_language"]))
    report.repartition("lang", spread).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("lang").parquet(target)
    unstash(notes, states, mapping, merged, others)
    counts = (F.count("*").alias("written"), F.count_if(F.col("n_merged") > 0).alias("merged"), F.count_if(F.size("related") > 0).alias("related"))
    found = rows_read(docs) | spark.read.schema(REPORT).parquet(target).agg(*counts).first().asDict()
    log.info("read %d documents from %s (%d without an id)", found["read"], source, found["without_id"])
    log.info("wrote %d notes to %s: %d with merged tags, %d with related notes", found["written"], target, found["merged"], found["related"])
    return found


if __name__ == "__main__":
    command_line(__doc__.splitlines()[0], related_notes)
