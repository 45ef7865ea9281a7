"""Exact de-duplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash, unstash
from .common import SPACE, join_groups, text_or_empty, with_filter

PREFIX_CHARS = 256


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def full_hash(text: str | Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """All columns of docs but text_col, and for each row keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one blank. Rows are
    counted by length, then by prefix hash within lengths that occur twice or more; only rows
    whose length and prefix hash both survive are grouped by the hash of their full text, the others
    are alone. text_sha256 is null for rows that are alone, unless digests asks for it: it is then
    an output of theirs, and decides nothing.

    Of equal texts the row with the smallest id stays; a null id comes last and stays only where
    all ids are null. Rows that repeat both id and text are one document: each is marked kept. A
    null text counts as empty. An empty table gives an empty result. Columns of docs named like
    an added one are replaced.

    Texts are not shuffled. No group is dealt to one task by its key if it is large: the few
    largest groups (their number is bounded) are broadcast, only the others shuffled.
    """
    added = {text_col, "keep_id", "group_size", "kept", "text_sha256"}
    old = [(f"c{k}", c) for k, c in enumerate(docs.columns) if c not in added or c == id_col]
    # columns are numbered meanwhile, so that their names cannot clash
    docs, own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), docs.columns
    names, text = [c for c, _ in old], normalised(f"c{own.index(text_col)}")
    id_col = f"c{own.index(id_col)}"
    marks = [F.length(text).alias("_chars"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_prefix")]
    counted = stash(docs.select(*marks).groupBy("_chars", "_prefix").agg(F.count("*").alias("n")), "exact-marks")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    lengths = counted.groupBy("_chars").agg(F.sum("n").alias("of_length")).where("of_length > 1")
    surviving = counted.join(lengths, "_chars", "left_semi").where("n > 1")
    rows = with_filter(docs.select(*names, *marks, text.alias("_text")), surviving, ["_chars", "_prefix"], "_survives")
    full = full_hash("_text") if digests else F.when(F.col("_survives"), full_hash("_text"))
    hashed = stash(rows.select(*names, "_survives", full.alias("text_sha256")), "exact-hashes")
    unstash(counted)

    rest = hashed.where("_survives").drop("_survives")
    groups = rest.groupBy("text_sha256").agg(F.min(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    groups = stash(groups.where("group_size > 1"), "exact-groups")
    one, own_id = F.lit(1).cast("long"), F.col(id_col)
    out = join_groups(rest, groups, ["text_sha256"], "group_size", total)
    out = out.withColumn("keep_id", F.when(F.col("group_size").isNull(), own_id).otherwise(F.col("keep_id")))
    out = out.withColumn("group_size", F.coalesce("group_size", one))
    alone = hashed.where("NOT _survives").drop("_survives").withColumn("keep_id", own_id).withColumn("group_size", one)
    out = out.unionByName(alone).withColumn("kept", F.col("keep_id").eqNullSafe(own_id))
    sha = F.col("text_sha256") if digests else F.when(F.col("group_size") > 1, F.col("text_sha256")).alias("text_sha256")
    return out.select(*(F.col(c).alias(name) for c, name in old), "keep_id", "group_size", "kept", sha)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups() keeps, whole and with their columns; rows that repeat
    both id and text come back once.

    A bounded bitmap of the ids that go, or of which one row of several stays, tells which rows may be
    among them: only their texts are hashed again and shuffled, all others pass in place."""
    groups = exact_groups(docs.select(id_col, text_col), id_col, text_col).where("group_size > 1")
    groups = stash(groups.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "exact-kept")
    dropped = groups.where("NOT kept").select("_id", "_sha").distinct()
    again = groups.where("kept").groupBy("_id", "_sha").count().where("count > 1")
    marked = dropped.select("_id").unionByName(again.select("_id"))
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = with_filter(rows.withColumn("_id", F.col(key)), marked, ["_id"])
    some = rows.where("_maybe").withColumn("_full", full_hash(normalised(text)))
    same = some["_id"].eqNullSafe(dropped["_id"]) & (some["_full"] == dropped["_sha"])
    some = some.join(dropped.hint("shuffle_hash"), same, "left_anti").dropDuplicates([key, "_full"])
    return rows.where("NOT _maybe").unionByName(some.drop("_full")).drop("_maybe", "_id").toDF(*docs.columns)
