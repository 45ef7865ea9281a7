"""Planned edits of notes as a log: replayed in order over the notes they were planned on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rewrite import first_replaced

EDITS = "path string, seq long, tie string, operation string, content string, target string, base_hash string"
#: Fixed: what an edit can do.
OPERATIONS = ("append", "prepend", "replace")


def edit_error(path: str, old: str | None, operation: str, content: str, target: str) -> str | None:
    """Why an edit of a text cannot be done, in the words of replayed(); for the tools of a model."""
    if not path:
        return "path is required"
    if not content:
        return "content is required"
    if old is None:
        return f"note '{path}' not found"
    if operation not in OPERATIONS:
        return "unknown operation"
    if operation == "replace" and not target:
        return "target is required"
    if operation == "replace" and target not in old:
        return "target not found"
    return None


def edit_applied(old: str, operation: str, content: str, target: str) -> str:
    """The text after an edit that has no error."""
    if operation == "append":
        return f"{old}\n{content}"
    if operation == "prepend":
        return f"{content}\n{old}"
    return old.replace(target, content, 1)


def step(done: Column, edit: Column) -> Column:
    """done (text, applied, failed) after one more edit."""
    op, piece, target = (F.coalesce(edit[c], F.lit("")) for c in ("operation", "content", "target"))
    text = done["text"]
    error = (
        F.when(piece == "", "content is required")
        .when(~op.isin(*OPERATIONS), "unknown operation")
        .when((op == "replace") & (target == ""), "target is required")
        .when((op == "replace") & ~F.contains(text, target), "target not found")
    )
    new = (
        F.when(op == "append", F.concat(text, F.lit("\n"), piece))
        .when(op == "prepend", F.concat(piece, F.lit("\n"), text))
        .otherwise(first_replaced(text, target, piece))
    )
    failed = F.when(error.isNull(), done["failed"]).otherwise(F.concat(done["failed"], F.array(F.struct(edit["seq"].alias("seq"), error.alias("error")))))
    return F.struct(
        F.when(error.isNull(), new).otherwise(text).alias("text"), (done["applied"] + F.when(error.isNull(), 1).otherwise(0)).alias("applied"), failed.alias("failed")
    )


def replayed(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, base_hash, new_content, n_applied, failed) for each note in edits (EDITS).

    A note's edits are done one after the other in the order of seq, then tie, each on what the one
    before left. An edit that cannot be done changes nothing and is in failed, array<struct<seq,error>>;
    the others go on. Edits are done only on the text they were planned on: where a note's content_hash
    is no longer the base_hash, or the note is gone, all its edits planned on another text are in failed,
    and edits planned on the present text are done. new_content is null where nothing was done. An edit
    without a path is left out. Edits of one note are few, as one model asks for them; notes are joined
    to them, not the other way round.
    """
    entry = F.struct("seq", F.coalesce("tie", F.lit("")).alias("tie"), "operation", "content", "target", "base_hash")
    listed = edits.where(F.coalesce("path", F.lit("")) != "").groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("edits"))
    rows = listed.join(notes.select("path", F.col("content").alias("_old"), F.col("content_hash").alias("_hash")), "path", "left")
    now = lambda e: e["base_hash"].eqNullSafe(F.col("_hash"))
    reason = F.when(F.col("_hash").isNull(), "note not found").otherwise("note changed since")
    stale = F.transform(F.filter("edits", lambda e: ~now(e)), lambda e: F.struct(e["seq"].alias("seq"), reason.alias("error")))
    none = F.array().cast("array<struct<seq:bigint,error:string>>")
    start = F.struct(F.coalesce("_old", F.lit("")).alias("text"), F.lit(0).alias("applied"), none.alias("failed"))
    rows = rows.withColumn("_stale", stale).withColumn("_valid", F.filter("edits", lambda e: now(e) & F.col("_hash").isNotNull()))
    rows = rows.withColumn("_done", F.aggregate("_valid", start, step))
    return rows.select(
        "path",
        F.col("_hash").alias("base_hash"),
        F.when(F.col("_done.applied") > 0, F.col("_done.text")).alias("new_content"),
        F.col("_done.applied").cast("long").alias("n_applied"),
        F.concat("_stale", F.col("_done.failed")).alias("failed"),
    )


def with_edits(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """notes as they are after their edits."""
    done = replayed(notes, edits).where("n_applied > 0").select("path", F.col("new_content").alias("_new"))
    new = F.coalesce("_new", "content").alias("content")
    return notes.join(done, "path", "left").select(*(new if c == "content" else F.col(c) for c in notes.columns))


def failures(replays: DataFrame) -> DataFrame:
    """(path, seq, error) of the edits that were not done."""
    return replays.select("path", F.explode("failed").alias("f")).select("path", "f.seq", "f.error")
