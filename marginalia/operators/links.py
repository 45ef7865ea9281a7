"""Wiki-link edges, and validation, repair and cleaning of proposed links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_hidden, name, outgoing_links, stem
from .edit_join import nearest_join
from .state import next_place

#: Fixed: the most edits of a fuzzy repair.
FUZZY_EDITS = 3


def edges(notes: DataFrame) -> DataFrame:
    """(src_path, pos, target): a row for each wiki-link, in order."""
    return notes.select(F.col("path").alias("src_path"), F.posexplode(outgoing_links(F.col("content"))).alias("pos", "target"))


def opened_texts(content: Column, longest: int) -> Column:
    """Each text of at most longest characters between an opening bracket pair and, at once after it, closing
    brackets or a bar: all of them, also those that hold such signs themselves."""
    tails = F.regexp_extract_all(content, F.lit(rf"(?s)(?=\[\[(.{{1,{longest + 2}}}))"), F.lit(1))
    ends = lambda tail: F.filter(
        F.sequence(F.lit(2), F.char_length(tail)), lambda k: (F.substring(tail, k, F.lit(1)) == "|") | (F.substring(tail, k, F.lit(2)) == "]]")
    )
    inside = lambda tail: F.when(F.char_length(tail) > 1, F.transform(ends(tail), lambda k: F.substring(tail, F.lit(1), k - 1)))
    return F.array_distinct(F.flatten(F.filter(F.transform(tails, inside), lambda x: x.isNotNull())))


def backlinks(notes: DataFrame) -> DataFrame:
    """(path, src_path): the notes whose text opens a link to a note's stem, up to the closing brackets
    or an alias bar; hidden notes and the note itself excluded.

    The text after each opening bracket pair, up to the next bracket or bar, is joined with stems by
    equality. Where there are stems that hold such signs themselves, the texts up to every later bracket
    or bar, as far as the longest of these stems reaches, are joined with them by equality too.
    """
    plain = r"\[\[([^\[\]|]*)(?=\]\]|\|)"
    sources = notes.where(~is_hidden(F.col("path")))
    names = notes.select("path", stem(F.col("path")).alias("stem"))
    opened = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(plain), F.lit(1))))
    named = sources.select(F.col("path").alias("src_path"), opened.alias("stem"))
    signs = F.col("stem").rlike(r"[\[\]|]")
    found = named.join(names.where(~signs), "stem").select("path", "src_path")
    odd = names.where(signs)
    longest = odd.agg(F.max(F.char_length("stem"))).first()[0]
    if longest:
        texts = F.explode(opened_texts(F.col("content"), longest))
        rare = sources.where(F.contains("content", F.lit("[["))).select(F.col("path").alias("src_path"), texts.alias("stem"))
        found = found.union(rare.join(odd, "stem").select("path", "src_path"))
    return found.where("path <> src_path").distinct()


def already_linked(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs of which one note's text links to the other's stem, by the raw link text."""
    distinct = links.select("src_path", "target").distinct()
    forth = pairs.join(distinct, (F.col("note_a") == F.col("src_path")) & (F.col("target") == stem(F.col("note_b"))), "left_semi")
    back = pairs.join(distinct, (F.col("note_b") == F.col("src_path")) & (F.col("target") == stem(F.col("note_a"))), "left_semi")
    return forth.unionByName(back).dropDuplicates(["note_a", "note_b"])


def linked_pairs(notes: DataFrame) -> DataFrame:
    """(path, other), both ways: notes of which one's text links to the other's stem, by the raw link text."""
    named = notes.select(F.col("path").alias("other"), stem(F.col("path")).alias("target"))
    forth = edges(notes).select("src_path", "target").distinct().join(named, "target").select(F.col("src_path").alias("path"), "other")
    return forth.unionByName(forth.select(F.col("other").alias("path"), F.col("path").alias("other"))).where("path <> other").distinct()


def proposals(states: DataFrame) -> DataFrame:
    """(path, ord, pos, target, reason): a row for each proposed link; a missing target is empty."""
    rows = states.select("path", "ord", F.posexplode("proposed_links").alias("pos", "link"))
    return rows.select("path", "ord", "pos", F.coalesce("link.target", F.lit("")).alias("target"), F.col("link.reason").alias("reason"))


def repairs(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, by_name, by_fuzzy): for each distinct target the file it names (with or without .md),
    and the one it may have meant: by file name or stem in any case, or by least edits of stems, at most
    FUZZY_EDITS. Ties go to the smallest path."""
    wanted = targets.select("target").distinct()
    named = files.select("path", name(F.col("path")).alias("file_name"))
    exact = named.groupBy("file_name").agg(F.min("path").alias("by_name"))
    spelled = wanted.select("target", F.explode(F.array_distinct(F.array("target", F.concat("target", F.lit(".md"))))).alias("file_name"))
    by_name = spelled.join(exact, "file_name").groupBy("target").agg(F.min("by_name").alias("by_name"))

    lowered = files.select("path", F.lower(name(F.col("path"))).alias("low_name"), F.lower(stem(F.col("path"))).alias("low_stem"))
    low_names = lowered.groupBy("low_name").agg(F.min("path").alias("by_low_name"))
    low_stems = lowered.groupBy("low_stem").agg(F.min("path").alias("by_low_stem"))
    rest = wanted.join(by_name, "target", "left").join(files.select(F.col("path").alias("target"), F.lit(True).alias("exact")), "target", "left")
    open_targets = rest.where("by_name IS NULL AND exact IS NULL").select("target")
    open_targets = open_targets.select("target", F.lower(name(F.col("target"))).alias("low_name"), F.lower(stem(F.col("target"))).alias("want"))
    staged = open_targets.join(low_names, "low_name", "left").join(low_stems.withColumnRenamed("low_stem", "want"), "want", "left")
    far = staged.where("by_low_name IS NULL AND by_low_stem IS NULL").select("want")
    close = nearest_join(far, "want", low_stems, "low_stem", FUZZY_EDITS).join(low_stems, "low_stem")
    close = close.groupBy("want").agg(F.min_by("by_low_stem", F.struct("edits", "by_low_stem")).alias("by_edits"))
    staged = staged.join(close, "want", "left")
    fuzzy = staged.select("target", F.coalesce("by_low_name", "by_low_stem", "by_edits").alias("by_fuzzy"))
    return wanted.join(by_name, "target", "left").join(fuzzy, "target", "left")


def validated(states: DataFrame, files: DataFrame, fix: bool = False) -> DataFrame:
    """Proposals with status, correction, counts_valid, counts_invalid, counts_fixed and
    counts_removed. status: valid, fixed, fixable, invalid or removed."""
    rows = proposals(states)
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("exists")).distinct()
    rows = rows.join(known, "target", "left").join(repairs(rows, files), "target", "left")
    exists, named, fuzzy = F.col("exists").isNotNull(), F.col("by_name").isNotNull(), F.col("by_fuzzy").isNotNull()
    if fix:
        status = F.when(exists, "valid").when(named | fuzzy, "fixed").otherwise("removed")
    else:
        status = F.when(exists | named, "valid").when(fuzzy, "fixable").otherwise("invalid")
    rows = rows.withColumn("status", status)
    rows = rows.withColumn("correction", F.when(~exists & (F.col("status") != "valid"), F.coalesce("by_name", "by_fuzzy")))
    bad = F.col("status").isin("fixable", "invalid", "removed")
    return rows.select(
        "path",
        "ord",
        "pos",
        "target",
        "reason",
        "status",
        "correction",
        (exists | named).alias("counts_valid"),
        bad.alias("counts_invalid"),
        (F.col("status") == "fixed").alias("counts_fixed"),
        (F.col("status") == "removed").alias("counts_removed"),
    )


def validation_counts(rows: DataFrame) -> DataFrame:
    names = ("valid", "invalid", "fixed", "removed")
    return rows.agg(*[F.count_if(F.col(f"counts_{n}")).alias(n) for n in names])


def _with_links(states: DataFrame, rows: DataFrame, order: str = "pos") -> DataFrame:
    """states with proposed_links collected again from (path, order, target, reason); notes without
    rows get an empty list."""
    entry = F.struct(order, F.struct("target", "reason").alias("link"))
    lists = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["link"]).alias("_links"))
    empty = F.array().cast(states.schema["proposed_links"].dataType)
    columns = [F.coalesce("_links", empty).alias(c) if c == "proposed_links" else F.col(c) for c in states.columns]
    return states.join(lists, "path", "left").select(*columns)


def fixed_links(states: DataFrame, files: DataFrame) -> DataFrame:
    """states with targets corrected and hopeless links dropped; a list that this empties is no longer
    marked applied."""
    rows = validated(states, files, fix=True).where("NOT counts_removed")
    rows = rows.select("path", "pos", F.coalesce("correction", "target").alias("target"), "reason")
    had = F.size(F.coalesce("proposed_links", F.array().cast(states.schema["proposed_links"].dataType))) > 0
    after = _with_links(states.withColumn("_had", had), rows)
    applied = F.when(F.col("_had") & (F.size("proposed_links") == 0), F.lit(False)).otherwise(F.col("links_applied"))
    return after.withColumn("links_applied", applied).drop("_had")


def deduplicated(states: DataFrame) -> DataFrame:
    """states with one link for each target: the longest reason, the first of equal ones, at the place
    of the target's first link."""
    rows = proposals(states)
    best = F.struct(F.coalesce(F.char_length("reason"), F.lit(0)), -F.col("pos"))
    kept = rows.groupBy("path", "target").agg(F.max_by("reason", best).alias("reason"), F.min("pos").alias("pos"))
    return _with_links(states, kept)


def without_self_links(states: DataFrame) -> DataFrame:
    kept = F.filter("proposed_links", lambda x: ~x["target"].eqNullSafe(F.col("path")))
    return states.withColumn("proposed_links", kept)


def removed_links(before: DataFrame, after: DataFrame) -> DataFrame:
    """(removed): how many proposed links a cleaning took away."""
    n = F.greatest(F.size("proposed_links"), F.lit(0)).cast("long")
    both = before.select(n.alias("n")).unionAll(after.select((-n).alias("n")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("removed"))


def with_verdicts(states: DataFrame, verdicts: DataFrame, place: int | None = None) -> DataFrame:
    """states with confirmed links added. verdicts: (note_a, note_b, link_from, link_to, reason, seq);
    link_from and link_to default to note_a and note_b. A target that the note already has, or had from
    an earlier verdict, is skipped. An unknown link_from becomes a bare record without a hash, after all
    others, or from place on."""
    rows = verdicts.select(
        F.coalesce("link_from", "note_a").alias("path"),
        F.coalesce("link_to", "note_b").alias("target"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        "seq",
    )
    rows = rows.groupBy("path", "target").agg(F.min_by("reason", "seq").alias("reason"), F.min("seq").alias("seq"))
    rows = rows.join(proposals(states).select("path", "target").distinct(), ["path", "target"], "left_anti")
    entry = F.struct("seq", F.struct("target", "reason").alias("link"))
    added = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["link"]).alias("_new"), F.min("seq").alias("_seq"))
    place = next_place(states) if place is None else place
    joined = states.join(added, "path", "full_outer")
    empty = F.array().cast(states.schema["proposed_links"].dataType)
    values = {
        "ord": F.coalesce("ord", F.lit(place) + F.col("_seq")),
        "proposed_links": F.concat(F.coalesce("proposed_links", empty), F.coalesce("_new", empty)),
        "links_applied": F.when(F.col("_new").isNotNull(), F.lit(False)).otherwise(F.col("links_applied")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in states.columns])
