"""The jobs as queries: each runs twice into a new folder, and what the folder then holds is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import MIN_SHARED, TAGGED, grouping
from marginalia.session import shared_dir

from .note_feed import note_feed, read_feed
from .related_notes import REPORT, related_notes


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex[:12]}"


def job1_related_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces the report with the same one."""
    folder = new_folder(spark, "related-notes")
    for _ in range(2):
        related_notes(spark, sf_dir, f"{folder}/report")
    report = spark.read.schema(REPORT).parquet(f"{folder}/report")
    others = F.transform("related", lambda x: F.concat_ws(":", x["path"], x["n_shared"]))
    return report.select("lang", "path", F.array_join("tags", ",").alias("tags"), "n_merged", F.array_join(others, ",").alias("related"))


def job2_note_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds no new file, and adds nothing."""
    folder = new_folder(spark, "note-feed")
    for _ in range(2):
        note_feed(spark, sf_dir, f"{folder}/feed", f"{folder}/progress")
    return read_feed(spark, f"{folder}/feed").select(
        "lang",
        "path",
        "content_hash",
        "status",
        "n_words",
        F.array_join("tags", ",").alias("tags"),
        F.size("links").cast("long").alias("n_links"),
    )


QUERIES = {"job1_related_notes": job1_related_notes, "job2_note_feed": job2_note_feed}

ORACLES = {
    "job1_related_notes": rf"""WITH RECURSIVE {TAGGED}, {grouping("tag_n")}, mapped AS (
            SELECT path, ord, coalesce(canonical, tag) AS tag, tag_pos, canonical IS NOT NULL AS moved
            FROM entries LEFT JOIN mapping ON variant = tag
        ), merged AS (
            SELECT path, ord, tag, min(tag_pos) AS tag_pos, count_if(moved) AS moved FROM mapped GROUP BY path, ord, tag
        ), pairs AS (
            SELECT a.path, b.path AS other, count(*) AS n_shared
            FROM merged a JOIN merged b ON a.tag = b.tag AND a.path <> b.path
            GROUP BY ALL HAVING count(*) >= {MIN_SHARED}
        ), linked AS (
            SELECT path, other FROM pairs JOIN docs a USING (path) JOIN docs b ON b.path = other
            WHERE regexp_matches(a.content, '\[\[' || b.lang || '-' || b.doc_id || '(\|[^\]]+)?\]\]')
                OR regexp_matches(b.content, '\[\[' || a.lang || '-' || a.doc_id || '(\|[^\]]+)?\]\]')
        ), chosen AS (
            SELECT path, other, n_shared, row_number() OVER (PARTITION BY path ORDER BY n_shared DESC, other) AS place
            FROM pairs ANTI JOIN linked USING (path, other) QUALIFY place <= 5
        ), listed AS (
            SELECT path, string_agg(other || ':' || n_shared, ',' ORDER BY place) AS related FROM chosen GROUP BY path
        ), tagged AS (
            SELECT path, string_agg(tag, ',' ORDER BY tag_pos) AS tags, sum(moved)::BIGINT AS n_merged FROM merged GROUP BY path
        )
        SELECT lang, path, coalesce(tags, '') AS tags, coalesce(n_merged, 0) AS n_merged, coalesce(related, '') AS related
        FROM docs LEFT JOIN tagged USING (path) LEFT JOIN listed USING (path)""",
    "job2_note_feed": rf"""WITH {TAGGED}, tagged AS (
            SELECT path, string_agg(tag, ',' ORDER BY tag_pos) AS tags FROM entries GROUP BY path
        )
        SELECT lang, path, substr(sha256(content), 1, 16) AS content_hash, 'new' AS status,
            len(regexp_extract_all(content, '[^\t\n\x0B\f\r ]+')) AS n_words, coalesce(tags, '') AS tags,
            len(regexp_extract_all(content, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)) AS n_links
        FROM docs LEFT JOIN tagged USING (path)""",
}
