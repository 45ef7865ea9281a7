"""Edits of notes as planned text: the plan is a table, writing it is a separate step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARK, frontmatter_end, frontmatter_text, link_title, right_trim, trim

# Fixed values of the note format.
TAG_LIST = r"(?U)tags:\s*\[([^\]]*)\]"
SECTION = "## Related Notes"
DASH = " — "


def first_replaced(text: Column, target: Column, new: Column) -> Column:
    """text with the first occurrence of target replaced; unchanged without one."""
    at = F.position(target, text)
    head = F.substring(text, F.lit(1), at - 1)
    rest = F.substring(text, at + F.char_length(target), F.char_length(text))
    return F.when(at > 0, F.concat(head, new, rest)).otherwise(text)


def edited(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, operation, new_content, error) of edits (path, operation, content, target). Exactly one
    of new_content and error is set."""
    asked = edits.select("path", "operation", F.col("content").alias("piece"), "target")
    rows = asked.join(notes.select("path", "content"), "path", "left")
    op, old, piece, target = (F.col(c) for c in ("operation", "content", "piece", "target"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    error = (
        F.when(blank(F.col("path")), "path is required")
        .when(blank(piece), "content is required")
        .when(old.isNull(), "note not found")
        .when(~op.isin("append", "prepend", "replace"), "unknown operation")
        .when((op == "replace") & blank(target), "target is required")
        .when((op == "replace") & ~F.contains(old, target), "target not found")
    )
    new = (
        F.when(op == "append", F.concat(old, F.lit("\n"), piece))
        .when(op == "prepend", F.concat(piece, F.lit("\n"), old))
        .otherwise(first_replaced(old, target, piece))
    )
    rows = rows.withColumn("error", error)
    return rows.select("path", "operation", F.when(F.col("error").isNull(), new).alias("new_content"), "error")


def tagged(content: Column, tags: Column) -> Column:
    """The text with tags in its frontmatter: merged into an inline list, added as a block beside
    another list, added as an inline list, or as new frontmatter."""
    inline = lambda x: F.concat(F.lit("tags: ["), F.array_join(x, ", "), F.lit("]"))
    end, front = frontmatter_end(content), frontmatter_text(content)
    body = F.substring(content, end + 3, F.char_length(content))
    listed = F.regexp_extract(front, TAG_LIST, 1)
    unquoted = lambda x: F.regexp_replace(F.regexp_replace(trim(x), r'^"+|"+$', ""), r"^'+|'+$", "")
    existing = F.transform(F.filter(F.split(listed, ","), lambda x: trim(x) != ""), unquoted)
    merged = F.array_sort(F.array_union(existing, tags))
    # a dollar sign or backslash in a tag is no reference
    quoted = F.regexp_replace(inline(merged), r"([\\$])", r"\\$1")
    block = F.concat(
        right_trim(front), F.lit("\ntags:\n"), F.array_join(F.transform(F.array_sort(F.array_distinct(tags)), lambda t: F.concat(F.lit("  - "), t)), "\n"), F.lit("\n")
    )
    added = F.concat(right_trim(front), F.lit("\n"), inline(F.array_sort(tags)), F.lit("\n"))
    new_front = (
        F.when(F.contains(front, F.lit("tags:")) & front.rlike(TAG_LIST), F.regexp_replace(front, F.lit(TAG_LIST), quoted))
        .when(F.contains(front, F.lit("tags:")), block)
        .otherwise(added)
    )
    fresh = F.concat(F.lit(MARK + "\n"), inline(F.array_sort(tags)), F.lit("\n" + MARK + "\n"), content)
    return F.when(end.isNull(), fresh).otherwise(F.concat(F.lit(MARK), new_front, F.lit(MARK), body))


def linked(content: Column, links: Column) -> Column:
    """The text with a line for each link under the section's heading; where the text already has the
    heading, at its end."""
    line = lambda x: F.concat(
        F.lit("- [["),
        link_title(x["target"]),
        F.lit("]]"),
        F.when(F.coalesce(x["reason"], F.lit("")) != "", F.concat(F.lit(DASH), x["reason"])).otherwise(F.lit("")),
    )
    rows = F.array_join(F.transform(links, line), "\n")
    heading = F.when(F.contains(content, F.lit(SECTION)), F.lit("\n")).otherwise(F.lit(f"\n\n{SECTION}\n"))
    return F.concat(right_trim(content), heading, rows)


def plan_tags(notes: DataFrame, pending: DataFrame) -> DataFrame:
    """(path, new_content, kind) of pending tags; notes that are gone are left out and stay pending."""
    rows = pending.select("path", "proposed_tags").join(notes.select("path", "content"), "path")
    return rows.select("path", tagged(F.col("content"), F.col("proposed_tags")).alias("new_content"), F.lit("tags").alias("kind"))


def plan_links(notes: DataFrame, pending: DataFrame) -> DataFrame:
    """(path, new_content, kind) of pending links."""
    rows = pending.select("path", "proposed_links").join(notes.select("path", "content"), "path")
    return rows.select("path", linked(F.col("content"), F.col("proposed_links")).alias("new_content"), F.lit("links").alias("kind"))
