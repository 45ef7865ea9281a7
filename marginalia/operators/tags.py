"""Tag counts, indexes, near-duplicate groups and their normalisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import THRESHOLD, are_similar, stem_tag
from ..session import stash, unstash
from .edit_join import pairs_of_ids
from .state import numbered

#: Pairs of similar stems in a range that one task holds, about.
MOST_EDGES = 1_000_000
#: Edges in a partition that is replaced by stars, about.
STAR_EDGES = 200_000
#: Entries of a tag that are paired with as many others at once.
TILE = 512
#: Tags of a note beyond which its sets of tags (two to that power) are more than the pairs they spare.
SET_TAGS = 10


def tag_index(states: DataFrame) -> DataFrame:
    """(tag, path, ord, tag_pos), one row for each time a note lists a tag; repeats included."""
    return states.select("path", "ord", F.posexplode("proposed_tags").alias("tag_pos", "tag")).select("tag", "path", "ord", "tag_pos")


def tag_counts(states: DataFrame) -> DataFrame:
    return states.select(F.explode("proposed_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def frequent_tags(index: DataFrame, max_frequency: int) -> DataFrame:
    """(tag, n) of tags that a cap drops; none when the cap is 0."""
    counts = index.groupBy("tag").agg(F.count("*").alias("n"))
    return counts.where(F.lit(max_frequency > 0) & (F.col("n") > max_frequency))


def capped_index(index: DataFrame, max_frequency: int) -> DataFrame:
    """The index without tags that have more than max_frequency entries; all of it when 0."""
    if max_frequency <= 0:
        return index
    return index.join(frequent_tags(index, max_frequency).select("tag"), "tag", "left_anti")


def stems(counts: DataFrame) -> DataFrame:
    """(stem, first_tag, tags) of distinct tags."""
    rows = counts.select("tag", stem_tag(F.col("tag")).alias("stem"))
    return rows.groupBy("stem").agg(F.min("tag").alias("first_tag"), F.array_sort(F.collect_set("tag")).alias("tags"))


def similar_stems(groups: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(earlier, later) pairs of similar stems, in the order of each stem's smallest tag, with their places in it
    (earlier_id, later_id)."""
    names = numbered(groups.select("stem", "first_tag"), F.col("first_tag"), name="id")
    # stems of one part that are two edits apart are similar if the longer one has more than ten characters:
    # a shorter one has one character less at least, and the other leaves that out
    fewer = F.lit(threshold == 2) & (F.char_length("stem") <= 10) & ~F.contains("stem", F.lit("-"))
    names = stash(names.select("id", "stem", "first_tag", fewer.alias("fewer")), "edit-strings")
    pairs = pairs_of_ids(names.select("id", F.col("stem").alias("string"), "fewer"), threshold)
    a = names.select(F.col("id").alias("a"), F.col("id").alias("earlier_id"), F.col("stem").alias("earlier"), F.col("first_tag").alias("earlier_tag"))
    b = names.select(F.col("id").alias("b"), F.col("id").alias("later_id"), F.col("stem").alias("later"), F.col("first_tag").alias("later_tag"))
    # there are many pairs to a stem, which the planner's sizes leave out: it would send all of them through the driver
    close = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(are_similar(F.col("earlier"), F.col("later"), threshold))
    return close.select("earlier", "later", "earlier_tag", "later_tag", "earlier_id", "later_id")


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y): of what the edges of one partition connect, each stem with the smallest one."""
    parent: dict[str, str] = {}

    def head(x: str) -> str:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sorted((head(parent.setdefault(a, a)), head(parent.setdefault(b, b))))
            parent[b] = a
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(parent, pa.string()), pa.array([head(x) for x in parent], pa.string())], ["x", "y"])


def pieces(edges: DataFrame) -> DataFrame:
    """(stem, piece) of the stems in edges (earlier, later): a piece is what edges connect, named by its
    smallest stem. Partitions first replace their edges by stars, which shortens all paths. Then each round
    takes the least name among neighbours, and that name's own; each is a written table."""
    n = -(-edges.count() // STAR_EDGES)
    pairs = edges.select("earlier", "later").repartition(max(1, n)).mapInArrow(stars, "x string, y string").where("x <> y")
    pairs = stash(pairs.union(pairs.select("y", "x")), "piece-edges")
    names = stash(pairs.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("stem"), F.least("x", "y").alias("piece")), "pieces")
    while True:
        near = pairs.join(names, pairs["y"] == names["stem"]).groupBy("x").agg(F.min("piece").alias("near"))
        best = names.join(near, names["stem"] == near["x"]).select("stem", F.col("piece").alias("old"), F.least("piece", "near").alias("best"))
        jump = names.select(F.col("stem").alias("best"), F.col("piece").alias("further"))
        moved = best.join(jump, "best", "left").select("stem", "old", F.least("best", "further").alias("piece"))
        moved = stash(moved, "pieces")
        unstash(names)
        names = moved.select("stem", "piece")
        if not moved.where("old <> piece").take(1):
            unstash(pairs)
            return names


def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, follows) of the later stems whose role is settled. Rows (earlier, later, ahead) are what is open of
    a range of later stems; ahead tells whether the earlier one leads, null if that is open; a row of a
    stem with itself only names it. Steps over all edges of the range settle what waits for nothing open,
    until a step settles nothing. What is held is one range."""
    found = [batch for batch in batches if batch.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found).combine_chunks()
    found.clear()
    stems = pc.unique(table.column("later"))
    later = pc.index_in(table.column("later"), stems).to_numpy()
    earlier = pc.index_in(table.column("earlier"), stems).fill_null(-1).to_numpy()
    # 1 leads, 0 follows, -1 open
    ahead = pc.fill_null(table.column("ahead").cast(pa.int8()), -1).to_numpy()
    n, edge = len(stems), later != earlier
    later, earlier, ahead = later[edge], earlier[edge], ahead[edge]
    role = np.full(n, -1, np.int8)
    led = np.zeros(n, bool)
    led[later[ahead == 1]] = True
    later, earlier = later[ahead < 0], earlier[ahead < 0]
    while True:
        waits = np.zeros(n, bool)
        waits[later] = True
        now = (role < 0) & (led | ~waits)
        if not now.any():
            break
        role[now] = ~led[now]
        state = np.where(earlier < 0, np.int8(-1), role[earlier])
        led[later[state == 1]] = True
        rest = (state < 0) & (role[later] < 0)
        later, earlier = later[rest], earlier[rest]
    settled = np.flatnonzero(role >= 0)
    yield pa.RecordBatch.from_arrays([stems.take(pa.array(settled)), pa.array(role[settled] == 0)], ["stem", "follows"])


def followers(edges: DataFrame) -> DataFrame:
    """(stem) of the stems that follow one, by the sequential rule; stems of edges (earlier, later, later_tag) may
    be named by numbers too. Each round takes ranges of later stems, each
    by itself: it settles whatever does not wait for an open stem of another range, the first range
    wholly, so there are never more rounds than ranges. Only open stems go on, and of their edges only those
    to stems that are open or lead: the others decide nothing. A row of each stem with itself stays as
    long as it is open."""
    later = edges.select("later", "later_tag").distinct()
    after = later.select(F.col("later").alias("earlier"), F.lit(True).alias("waits"))
    ahead = F.when(F.col("waits").isNull(), True).alias("ahead")
    named = later.select(F.col("later").alias("earlier"), "later", "later_tag", F.lit(None).cast("boolean").alias("ahead"))
    rest = edges.join(after, "earlier", "left").select("earlier", "later", "later_tag", ahead)
    rest = stash(rest.unionByName(named), "open-edges")
    rounds, kind = [], edges.schema["later"].dataType.simpleString()
    sizes = F.count("*"), F.count_if(F.col("earlier") != F.col("later"))
    while any(found := rest.agg(*sizes).first()):
        ranges = max(1, -(-found[1] // max(1, MOST_EDGES)))
        dealt = rest.repartitionByRange(ranges, "later_tag").select("earlier", "later", "ahead")
        roles = stash(dealt.mapInArrow(decided, f"stem {kind}, follows boolean"), "stem-roles")
        rounds.append(roles)
        if ranges == 1:
            break
        still = rest.join(roles.select(F.col("stem").alias("later")), "later", "left_anti")
        known = roles.select(F.col("stem").alias("earlier"), (~F.col("follows")).alias("leads"))
        still = still.join(known, "earlier", "left").where("leads OR leads IS NULL")
        still = stash(still.select("earlier", "later", "later_tag", F.coalesce("ahead", "leads").alias("ahead")), "open-edges")
        unstash(rest)
        rest = still
    if not rounds:
        return edges.select(F.col("later").alias("stem")).limit(0)
    return reduce(DataFrame.union, rounds).where("follows").select("stem")


def leaders(groups: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(stem, leader): greedy clustering. In the order of smallest tags a stem leads unless an earlier
    leader is similar to it, and then follows the earliest such leader.

    Only stems with a similar one take part. Which of them follow is settled in rounds over ranges of
    about MOST_EDGES pairs; what is similar to an earlier one that does not follow has its leader there.
    """
    edges = stash(similar_stems(groups, threshold), "similar-stems")
    if "later_id" in edges.columns:
        # numbers are less to deal out than texts
        of = edges.select(F.col("earlier_id").alias("earlier"), F.col("later_id").alias("later"), F.col("later_id").alias("later_tag"))
        heads = edges.join(followers(of).select(F.col("stem").alias("earlier_id")), "earlier_id", "left_anti")
    else:
        heads = edges.join(followers(edges).select(F.col("stem").alias("earlier")), "earlier", "left_anti")
    best = heads.groupBy(F.col("later").alias("stem")).agg(F.min_by("earlier", "earlier_tag").alias("leader"))
    return groups.select("stem").join(best, "stem", "left").select("stem", F.coalesce("leader", "stem").alias("leader"))


def tag_groups(counts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(leader, tag, n) of the tags in groups of two or more."""
    named = stash(counts.select("tag", "n", stem_tag(F.col("tag")).alias("stem")), "tag-stems")
    groups = named.groupBy("stem").agg(F.min("tag").alias("first_tag"))
    rows = named.join(leaders(groups, threshold), "stem").select("leader", "tag", "n")
    many = rows.groupBy("leader").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(many, "leader").select("leader", "tag", "n")


def canonical_groups(counts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(canonical, variants) of each group: the shortest tag, of those the first in the group (its
    leader's tags first, then by stem), and all its tags sorted."""
    rows = tag_groups(counts, threshold).withColumn("stem", stem_tag(F.col("tag")))
    firsts = rows.groupBy("stem").agg(F.min("tag").alias("first_tag"))
    rows = rows.join(firsts, "stem")
    rank = F.struct(F.char_length("tag"), (F.col("stem") != F.col("leader")), "first_tag", "tag")
    return rows.groupBy("leader").agg(F.min_by("tag", rank).alias("canonical"), F.array_sort(F.collect_list("tag")).alias("variants")).drop("leader")


def normalization_map(counts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(variant, canonical): the most frequent tag of a group, then the shortest, then the smallest."""
    rows = tag_groups(counts, threshold)
    rank = F.struct(-F.col("n"), F.char_length("tag"), F.col("tag"))
    best = rows.groupBy("leader").agg(F.min_by("tag", rank).alias("canonical"))
    return rows.join(best, "leader").where("tag <> canonical").select(F.col("tag").alias("variant"), "canonical")


def merge_preview(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(canonical, n, variants): what would be merged, variants by falling count then name."""
    rows = mapping.join(counts.withColumnRenamed("tag", "variant"), "variant", "left")
    entry = F.struct((-F.coalesce("n", F.lit(0))).alias("rank"), F.col("variant").alias("tag"))
    merged = rows.groupBy("canonical").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    merged = merged.join(counts.withColumnRenamed("tag", "canonical"), "canonical", "left")
    return merged.select("canonical", F.coalesce("n", F.lit(0)).alias("n"), F.transform("entries", lambda x: x["tag"]).alias("variants"))


def normalized(states: DataFrame, mapping: DataFrame) -> DataFrame:
    """states with proposed_tags mapped and each kept once, in order; and replaced: how many were
    mapped, repeats included. tags_applied stays."""
    rows = states.select("path", F.posexplode_outer("proposed_tags").alias("pos", "tag"))
    rows = rows.join(mapping.withColumnRenamed("variant", "tag"), "tag", "left")
    entry = F.struct("pos", F.coalesce("canonical", "tag").alias("tag"))
    found = rows.where("pos IS NOT NULL").groupBy("path").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["tag"])).alias("new_tags"),
        F.count_if(F.col("canonical").isNotNull() & (F.col("canonical") != F.col("tag"))).alias("replaced"),
    )
    tags = F.coalesce("new_tags", "proposed_tags").alias("proposed_tags")
    columns = [tags if c == "proposed_tags" else F.col(c) for c in states.columns]
    return states.join(found, "path", "left").select(*columns, F.coalesce("replaced", F.lit(0)).alias("replaced"))


def prefix_entries(entries: DataFrame, min_shared: int) -> DataFrame:
    """(tag, path, twice) of the entries by which pairs are found. A note's tags are ordered from the rarest
    to the most frequent: two notes that share min_shared tags share one among all but the last
    min_shared - 1 of each. The order is by tag alone, so it is the same in all notes. A note that lists a
    tag twice may reach min_shared by one tag; it is found by all its tags (twice), from its side and from
    the others'."""
    listed = entries.groupBy("tag", "path").agg(F.count("*").alias("times"))
    counts = listed.groupBy("tag").agg(F.sum("times").alias("n"))
    by = Window.partitionBy("path").orderBy("n", "tag")
    whole = Window.partitionBy("path")
    rows = listed.join(counts, "tag").withColumn("place", F.row_number().over(by))
    rows = rows.withColumn("size", F.count("*").over(whole)).withColumn("twice", F.max("times").over(whole) > 1)
    return rows.select("tag", "path", "twice", (F.col("place") <= F.col("size") - (min_shared - 1)).alias("first"))


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """(note_a, note_b): the pairs of a row of left and one of right, or of two rows of the same table, with
    the same tag. Tags with more than TILE
    entries are split: each side into parts, and every part of one side meets every part of the other
    in a group of its own."""
    sizes = left.groupBy("tag").agg(F.count("*").alias("m")).join(right.groupBy("tag").agg(F.count("*").alias("n")), "tag")
    parts = sizes.select("tag", F.ceil(F.col("m") / TILE).alias("rows"), F.ceil(F.col("n") / TILE).alias("columns"))
    part = lambda c: F.pmod(F.xxhash64("path"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = left.join(parts, "tag").select("tag", part("rows").alias("r"), every("columns").alias("c"), F.col("path").alias("path_a"))
    b = right.join(parts, "tag").select("tag", every("rows").alias("r"), part("columns").alias("c"), F.col("path").alias("path_b"))
    pairs = a.join(b, ["tag", "r", "c"]).where("path_a < path_b" if left is right else "path_a <> path_b")
    return pairs.select(F.least("path_a", "path_b").alias("note_a"), F.greatest("path_a", "path_b").alias("note_b"))


def candidate_pairs(entries: DataFrame, min_shared: int) -> DataFrame:
    """(note_a, note_b), each once, of all notes that may share min_shared tags, and few others."""
    found = stash(prefix_entries(entries, min_shared), "tag-prefixes")
    first = found.where("first AND NOT twice")
    return met(first, first).union(met(found.where("twice"), found)).distinct()


def shared_tag_pairs(index: DataFrame, min_shared: int = 2, max_frequency: int = 0, distinct: bool = False) -> DataFrame:
    """(note_a, note_b, n_shared, shared): pairs of notes with at least min_shared common tags, paths in
    string order; shared is in index order.

    A tag that a note lists twice counts for each pair of listings, as the index has it, unless
    distinct. A cap leaves out frequent tags, and is the default of the command. Without one, pairs are
    found by the rarer tags of each note, the few tags that stay frequent among these being split, and
    only pairs found so are counted: they share a rarer tag at least.
    """
    entries = capped_index(index, max_frequency)
    if distinct:
        entries = entries.groupBy("tag", "path").agg(F.min("ord").alias("ord"), F.min("tag_pos").alias("tag_pos"))
    order = F.struct("ord", "tag_pos")
    # a tag's place is that of its first entry in the whole index
    places = entries.groupBy("tag").agg(F.min(order).alias("place"))
    entries = stash(entries.join(places, "tag").select("tag", "path", order.alias("at"), "place"), "tag-entries")
    pairs = stash(candidate_pairs(entries, min_shared), "tag-candidates")
    a = entries.select("tag", "place", F.col("path").alias("note_a"), F.col("at").alias("at_a"))
    b = entries.select("tag", F.col("path").alias("note_b"), F.col("at").alias("at_b"))
    rows = pairs.join(a, "note_a").join(b, ["note_b", "tag"])
    # of two listings the earlier one comes first
    rows = rows.select("note_a", "note_b", "tag", "place", F.least("at_a", "at_b").alias("at_a"), F.greatest("at_a", "at_b").alias("at_b"))
    shared = F.array_sort(F.collect_list(F.struct("place", "at_a", "at_b", "tag")))
    grouped = rows.groupBy("note_a", "note_b").agg(F.count("*").alias("n_shared"), shared.alias("entries"))
    grouped = grouped.where(F.col("n_shared") >= min_shared)
    return grouped.select("note_a", "note_b", "n_shared", F.transform("entries", lambda x: x["tag"]).alias("shared"))


def tag_sets(index: DataFrame, min_shared: int) -> DataFrame:
    """(id, path, tags): the tags of each note that other notes have too, as sorted numbers, of notes with
    min_shared of these. Ids are in the order of paths."""
    listed = index.select("tag", "path").distinct()
    common = numbered(listed.groupBy("tag").agg(F.count("*").alias("n")).where("n > 1").select("tag"), F.col("tag"), name="number")
    sets = listed.join(common, "tag").groupBy("path").agg(F.array_sort(F.collect_list("number")).alias("tags"))
    return stash(numbered(sets.where(F.size("tags") >= min_shared), F.col("path"), name="id"), "tag-sets")


def tag_parts(tags: Column, least: int) -> Column:
    """All parts of a set with at least so many members."""
    both = lambda found, tag: F.concat(found, F.transform(found, lambda part: F.array_append(part, tag)))
    return F.filter(F.aggregate(tags, F.array(F.array().cast("array<bigint>")), both), lambda part: F.size(part) >= least)


def first_sharers(sets: DataFrame, apart: DataFrame, most: int, min_shared: int) -> DataFrame:
    """(id, other, n_shared): at least the most notes that share most tags with each note, and some others, for
    which n_shared may be too small. Pairs (id, other) in apart do not count as such.

    Notes are listed under every part of their tags, by id. Another note stands in the list of exactly the
    tags that it shares with a note; those before it there share no fewer, so it is among the most only if
    it stands within the first most of them, with the note itself and what is apart from it left out. Where
    a list is so long, lists of fewer tags give nothing more. So what is read of the lists grows with the
    notes and with what is apart, however many notes have a tag.
    """
    keys = sets.select("id", F.explode(tag_parts(F.col("tags"), min_shared)).alias("part"))
    # numbers are sorted faster than arrays; parts with the same mark stay apart
    keys = keys.withColumn("mark", F.xxhash64("part"))
    lists = numbered(keys, F.col("mark"), F.col("part"), F.col("id"), name="at")
    spans = lists.groupBy("mark", "part").agg(F.min("at").alias("start"), F.count("*").alias("n")).where("n > 1")
    near = lists.join(spans.hint("merge"), ["mark", "part"]).select("id", F.size("part").cast("long").alias("n_shared"), "start", "n")
    depths = apart.groupBy("id").agg(F.count("*").alias("left_out"))
    near = near.join(depths, "id", "left").withColumn("depth", F.lit(most + 1) + F.coalesce("left_out", F.lit(0)))
    enough = F.max(F.when(F.col("n") >= F.col("depth"), F.col("n_shared"))).over(Window.partitionBy("id"))
    near = near.withColumn("enough", enough).where("enough IS NULL OR n_shared >= enough")
    places = F.sequence(F.col("start"), F.col("start") + F.least("n", "depth") - 1)
    near = near.select("id", "n_shared", F.explode(places).alias("at"))
    return near.join(lists.select("at", F.col("id").alias("other")).hint("merge"), "at").select("id", "other", "n_shared")


def most_shared(index: DataFrame, apart: DataFrame, most: int, min_shared: int = 2) -> DataFrame:
    """(path, other, n_shared, place): for each note the notes that share most tags with it, min_shared at least,
    ties by path; without those that apart (path, other) names. A tag that a note lists twice counts
    once. No tag is too frequent: pairs are not listed, unless some note has more than SET_TAGS common tags.
    """
    least = max(1, min_shared)
    sets = tag_sets(index, least)
    one, two = sets.select("id", "path", "tags"), sets.select(F.col("id").alias("other_id"), F.col("path").alias("other"), F.col("tags").alias("others"))
    met = apart.join(one, "path").join(two, "other").where(F.size(F.array_intersect("tags", "others")) >= least)
    met = stash(met.select("id", F.col("other_id").alias("other")).distinct(), "notes-apart")
    if (sets.agg(F.max(F.size("tags"))).first()[0] or 0) <= SET_TAGS:
        found = first_sharers(sets, met, max(0, most), least)
    else:
        pairs = shared_tag_pairs(index, least, distinct=True)
        pairs = pairs.join(one.select("id", F.col("path").alias("note_a")), "note_a").join(two.select("other_id", F.col("other").alias("note_b")), "note_b")
        found = pairs.select("id", F.col("other_id").alias("other"), "n_shared")
        found = found.unionByName(found.select(F.col("other").alias("id"), F.col("id").alias("other"), "n_shared"))
    found = found.where("id <> other").groupBy("id", "other").agg(F.max("n_shared").alias("n_shared"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n_shared"), "other"))
    best = found.join(met, ["id", "other"], "left_anti").withColumn("place", place).where(F.col("place") <= most)
    best = best.join(one.select("id", "path"), "id").withColumnRenamed("other", "other_id")
    return best.join(two.select("other_id", "other"), "other_id").select("path", "other", "n_shared", "place")


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs by falling overlap, then by path."""
    return pairs.orderBy(F.desc("n_shared"), "note_a", "note_b")


def unevaluated(pairs: DataFrame, evaluated: DataFrame) -> DataFrame:
    return pairs.join(evaluated.select("note_a", "note_b"), ["note_a", "note_b"], "left_anti")


def skipped_tags(index: DataFrame, max_frequency: int) -> DataFrame:
    """Tags that the cap drops, most frequent first; equal counts in index order."""
    counts = index.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct("ord", "tag_pos")).alias("first_seen"))
    dropped = counts.where(F.lit(max_frequency > 0) & (F.col("n") > max_frequency))
    return dropped.orderBy(F.desc("n"), "first_seen").select("tag", "n")


def deterministic_tags(notes: DataFrame, most: int = 6, least_chars: int = 7) -> DataFrame:
    """(path, proposed_tags): a note's most frequent long words, ties by word. Stands in for a model."""
    words = notes.select("path", F.explode(F.split(F.lower("content"), r"\s+")).alias("word"))
    words = words.select("path", F.regexp_replace("word", "[^a-z]", "").alias("tag")).where(F.length("tag") >= least_chars)
    counts = words.groupBy("path", "tag").agg(F.count("*").alias("n"))
    best = Window.partitionBy("path").orderBy(F.desc("n"), "tag")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    entries = F.array_sort(F.collect_list(F.struct("rank", "tag")))
    return top.groupBy("path").agg(F.transform(entries, lambda x: x["tag"]).alias("proposed_tags"))
