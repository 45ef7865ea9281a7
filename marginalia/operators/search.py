"""Line search and note look-ups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, frontmatter, inline_tags, is_hidden, lines, sort_key, trim

#: Fixed: a search stops after the note that brings it above so many lines.
MOST_LINES = 100


def note_lines(notes: DataFrame) -> DataFrame:
    """(path, line_no, line), numbered from 1."""
    rows = notes.select("path", F.posexplode(lines(F.col("content"))).alias("at", "line"))
    return rows.select("path", (F.col("at") + 1).alias("line_no"), "line")


def java_pattern(spark, query: str) -> str:
    """The query as a case-insensitive Unicode pattern, or as plain text where it is no valid pattern
    in Python's or Java's syntax."""
    plain = "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", query)
    pattern = "(?iu)" + query
    try:
        re.compile(query)
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  either compiler's complaint
        return plain
    return pattern


def readable(notes: DataFrame) -> DataFrame:
    """Notes that a search reads: hidden and undecodable ones are left out."""
    shown = notes.where(~is_hidden(F.col("path")))
    return shown.where("valid_utf8") if "valid_utf8" in notes.columns else shown


def search_lines(notes: DataFrame, query: str) -> DataFrame:
    """(path, line_no, line) of matching lines, trimmed; hidden and undecodable notes are left out."""
    pattern = java_pattern(notes.sparkSession, query)
    return note_lines(readable(notes)).where(F.col("line").rlike(pattern)).withColumn("line", trim(F.col("line")))


def search(notes: DataFrame, query: str, most: int = MOST_LINES) -> DataFrame:
    """(path, line_no, line, truncated): all matching lines of the notes, in path order, up to and
    including the note that brings the total above most. truncated marks that note's lines.

    Each note found has a line at least, so the first most + 1 of them settle the cutoff: a distributed
    top-k of notes by how many of their lines match, and an ordered window over its few rows. Only the
    notes that are left are cut into rows.
    """
    pattern = java_pattern(notes.sparkSession, query)
    matching = F.size(F.filter(lines(F.col("content")), lambda x: x.rlike(pattern))).cast("long")
    counts = readable(notes).select("path", matching.alias("n")).where("n > 0")
    counts = counts.groupBy("path").agg(F.sum("n").alias("n")).orderBy(sort_key(F.col("path"))).limit(most + 1)
    before = Window.orderBy(sort_key(F.col("path"))).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") <= most)
    counts = F.broadcast(counts.select("path", (F.col("before") + F.col("n") > most).alias("truncated")))
    found = search_lines(notes.join(counts.select("path"), "path", "left_semi"), query)
    return found.join(counts, "path").select("path", "line_no", "line", "truncated")


def list_notes(notes: DataFrame, folder: str = "") -> DataFrame:
    """(path) of the notes under a folder, in component order; hidden ones are left out."""
    rows = notes.where(~is_hidden(F.col("path")))
    if folder:
        rows = rows.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    return rows.select("path").orderBy(sort_key(F.col("path")))


def read_note(notes: DataFrame, path: str) -> DataFrame:
    return notes.where(F.col("path") == path).select("path", "content")


def metadata(notes: DataFrame) -> DataFrame:
    """(path, fields, tags): frontmatter and inline tags."""
    return notes.select("path", frontmatter(F.col("content")).alias("fields"), inline_tags(F.col("content")).alias("tags"))


def hashed(notes: DataFrame) -> DataFrame:
    return notes.withColumn("content_hash", content_hash(F.col("content")))
