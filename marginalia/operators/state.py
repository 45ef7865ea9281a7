"""State of notes as tables: incremental scan, upserts, pending work, summary, JSON interchange."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_hidden, sort_key
from ..session import stash

LINK = "struct<target:string,reason:string>"
RECORD = (
    f"struct<content_hash:string,processed_at:double,proposed_tags:array<string>,"
    f"proposed_links:array<{LINK}>,tags_applied:boolean,links_applied:boolean>"
)
STATE = (
    f"path string, ord long, content_hash string, processed_at double, proposed_tags array<string>, "
    f"proposed_links array<{LINK}>, tags_applied boolean, links_applied boolean"
)
PAIRS = "note_a string, note_b string"
RUNS = "version int, last_run double, last_completed_run double"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def changed(notes: DataFrame, states: DataFrame, force: bool = False) -> DataFrame:
    """The notes that are new or whose hash differs, all readable ones with force; the undecodable only
    with force. Hidden ones never."""
    rows = notes.where(~is_hidden(F.col("path")))
    if force:
        return rows
    if "valid_utf8" in notes.columns:
        rows = rows.where("valid_utf8")
    known = states.select("path", F.col("content_hash").alias("_known"), F.lit(True).alias("_seen"))
    rows = rows.join(known, "path", "left")
    return rows.where(F.col("_seen").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_known"))).drop("_known", "_seen")


def in_order(notes: DataFrame) -> DataFrame:
    return notes.orderBy(sort_key(F.col("path")))


def numbered(rows: DataFrame, *order: Column, name: str = "seq") -> DataFrame:
    """rows with consecutive numbers from 0 in an order: sorted by ranges, numbered within each, and
    shifted by the sizes of the ranges before. Only those sizes meet in one task."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.withColumn("_range", F.spark_partition_id()).withColumn("_row", within)
    ranged = stash(ranged, "numbered")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_row")).drop("_range", "_row", "_start")


def next_place(states: DataFrame) -> int:
    """The place after all others."""
    return states.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1


def placed(results: DataFrame, states: DataFrame) -> DataFrame:
    """results with ord: the old place of a known path, for new ones a place after all others by seq."""
    places = states.select("path", F.col("ord").alias("_ord"))
    new = F.lit(next_place(states)) + F.col("seq")
    return results.join(places, "path", "left").withColumn("ord", F.coalesce("_ord", new)).drop("_ord")


def processed(results: DataFrame, now: Column | None = None) -> DataFrame:
    """The records of results (path, ord, content_hash, proposed_tags, proposed_links), flags reset."""
    return results.select(
        "path",
        "ord",
        "content_hash",
        (now if now is not None else F.unix_micros(F.current_timestamp()) / 1e6).alias("processed_at"),
        F.coalesce("proposed_tags", F.array().cast("array<string>")).alias("proposed_tags"),
        F.coalesce("proposed_links", F.array().cast(f"array<{LINK}>")).alias("proposed_links"),
        F.lit(False).alias("tags_applied"),
        F.lit(False).alias("links_applied"),
    )


def mark_processed(states: DataFrame, results: DataFrame, now: Column | None = None) -> DataFrame:
    """states with the records of results (path, content_hash, proposed_tags, proposed_links, seq) put
    in: flags reset, the old place kept, new notes after all others by seq."""
    new = processed(placed(results, states), now)
    return states.join(results.select("path"), "path", "left_anti").unionByName(new)


def newest_records(deltas: DataFrame, keep: bool = False) -> DataFrame:
    """Of records with versions the newest of each path; with keep its version too."""
    names = [c for c in deltas.columns if keep or c != "version"]
    return deltas.groupBy("path").agg(F.max_by(F.struct(*names), "version").alias("r")).select("r.*")


def merged_log(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """base with the newest record of each path in deltas (its columns, and version) put in."""
    newest = newest_records(deltas)
    return base.join(newest.select("path"), "path", "left_anti").unionByName(newest)


def changed_records(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of after that before does not have as they are."""
    old = before.select("path", F.struct(*before.columns).alias("_old"))
    rows = after.join(old, "path", "left")
    return rows.where(~F.struct(*before.columns).eqNullSafe(F.col("_old"))).select(*before.columns)


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """(note_a, note_b) with paths in string order."""
    return pairs.select(F.least("note_a", "note_b").alias("note_a"), F.greatest("note_a", "note_b").alias("note_b"))


def mark_evaluated(evaluated: DataFrame, pairs: DataFrame) -> DataFrame:
    """The evaluated pairs and these, each once, with paths in string order."""
    return evaluated.unionByName(ordered_pairs(pairs)).distinct()


def pending_tags(states: DataFrame) -> DataFrame:
    rows = states.where((F.size("proposed_tags") > 0) & ~F.coalesce("tags_applied", F.lit(False)))
    return rows.select("path", "ord", "proposed_tags")


def pending_links(states: DataFrame) -> DataFrame:
    rows = states.where((F.size("proposed_links") > 0) & ~F.coalesce("links_applied", F.lit(False)))
    return rows.select("path", "ord", "proposed_links")


def mark_applied(states: DataFrame, paths: DataFrame, flag: str) -> DataFrame:
    """states with flag (tags_applied or links_applied) set for these paths; unknown ones are ignored
    and hashes stay."""
    done = paths.select("path").distinct().withColumn("_done", F.lit(True))
    value = F.when(F.col("_done"), F.lit(True)).otherwise(F.col(flag)).alias(flag)
    return states.join(done, "path", "left").select(*[value if c == flag else F.col(c) for c in states.columns])


def summary(states: DataFrame) -> DataFrame:
    """(total, pending_tags, pending_links)."""
    tags = (F.size("proposed_tags") > 0) & ~F.coalesce("tags_applied", F.lit(False))
    links = (F.size("proposed_links") > 0) & ~F.coalesce("links_applied", F.lit(False))
    return states.agg(F.count("*").alias("total"), F.count_if(tags).alias("pending_tags"), F.count_if(links).alias("pending_links"))


def first_notes(notes: DataFrame, most: int = 10) -> DataFrame:
    """The first notes to process, in component order: the report's list."""
    return in_order(notes).limit(most)


def from_json(text: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, evaluated pairs, runs) of one row with the state file's text in value. Keys that older
    files lack are empty or null."""
    schema = f"struct<version:int,notes:map<string,{RECORD}>,evaluated_pairs:array<string>,last_run:double,last_completed_run:double>"
    row = text.select(F.from_json("value", schema).alias("s")).select("s.*")
    notes = row.select(F.posexplode(F.map_entries("notes")).alias("at", "note"))
    states = notes.select(F.col("note.key").alias("path"), F.col("at").cast("long").alias("ord"), "note.value.*")
    pairs = row.select(F.explode("evaluated_pairs").alias("pair"))
    return states, split_pairs(pairs), row.select("version", "last_run", "last_completed_run")


def split_pairs(pairs: DataFrame) -> DataFrame:
    """(note_a, note_b) of pairs of paths with a bar between them; a path of an older file that holds one
    is cut at the first."""
    return pairs.where(F.col("pair").contains("|")).select(
        F.substring_index("pair", "|", 1).alias("note_a"), F.regexp_replace("pair", r"(?s)^[^|]*\|", "").alias("note_b")
    )


#: Fixed by json_lines(): the first line of a state file with an entry on each line.
HEAD = '{"version":1,"notes":{'


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, evaluated pairs, runs) of a state file, or of a folder of its parts. A file with an entry on
    each line, as json_lines() gives it, is read in splits; any other is one document and is read whole."""
    lines = spark.read.text(path)
    if lines.where(F.col("value") == HEAD).take(1):
        return from_lines(lines)
    return from_json(spark.read.format("text").option("wholetext", True).load(path))


def from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """from_json() of a state file that is read by lines; ord is the place among the notes' lines."""
    word = r'"(?:[^"\\]++|\\.)*+"'
    entry = F.regexp_replace("value", "^,", "")
    place = [F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    rows = lines.select(*(c.alias(f"p{k}") for k, c in enumerate(place)), "value", entry.alias("entry"))
    notes = rows.where(F.col("value").rlike(rf"^,?{word}:\{{"))
    notes = numbered(notes, F.col("p0"), F.col("p1"), F.col("p2"), name="ord")
    record = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), f"map<string,{RECORD}>")
    states = notes.select("ord", F.explode(record).alias("path", "note")).select("path", "ord", "note.*")
    pairs = rows.where(F.col("value").rlike(rf"^,?{word}$"))
    pairs = pairs.select(F.get(F.from_json(F.concat(F.lit("["), "entry", F.lit("]")), "array<string>"), F.lit(0)).alias("pair"))
    last = F.concat(F.lit('{"version":1,'), F.regexp_replace("value", r"^\],", ""))
    runs = rows.where(F.col("value").startswith("],")).select(F.from_json(last, RUNS).alias("s")).select("s.*")
    return states, split_pairs(pairs), runs


def json_lines(states: DataFrame, evaluated: DataFrame, last_run: float | None = None, last_completed_run: float | None = None) -> DataFrame:
    """(section, seq, value): the lines of the state file in order, each note and each pair on one; sorted by
    ranges over many tasks. Written as text, its parts one after the other are the file."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    comma = F.when(F.col("seq") > 0, ",").otherwise("")
    record = F.struct("content_hash", "processed_at", "proposed_tags", "proposed_links", "tags_applied", "links_applied")
    whole = {"ignoreNullFields": "false"}
    notes = numbered(states.withColumn("record", F.to_json(record, whole)).select("path", "ord", "record"), F.col("ord"), F.col("path"))
    notes = notes.select(F.lit(1).alias("section"), "seq", F.concat(comma, quoted(F.col("path")), F.lit(":"), "record").alias("value"))
    pairs = evaluated.select(F.concat_ws("|", "note_a", "note_b").alias("pair"))
    pairs = numbered(pairs, F.col("pair"))
    pairs = pairs.select(F.lit(3).alias("section"), "seq", F.concat(comma, quoted(F.col("pair"))).alias("value"))
    runs = json.dumps({"last_run": last_run, "last_completed_run": last_completed_run}, separators=(",", ":"))
    frame = [(0, 0, HEAD), (2, 0, '},"evaluated_pairs":['), (4, 0, f"],{runs[1:]}")]
    frame = states.sparkSession.createDataFrame(frame, "section int, seq long, value string")
    lines = frame.unionByName(notes).unionByName(pairs)
    return lines.repartitionByRange("section", "seq").sortWithinPartitions("section", "seq")


def write_json(lines: DataFrame, folder: str) -> None:
    """json_lines() as text files in a folder."""
    lines.select("value").write.text(folder)


def to_json(states: DataFrame, evaluated: DataFrame, last_run: float | None = None, last_completed_run: float | None = None) -> str:
    """The state file's text; for small states, as the text is whole on the driver."""
    lines = json_lines(states, evaluated, last_run, last_completed_run).orderBy("section", "seq")
    return "\n".join(row["value"] for row in lines.toLocalIterator())


def schema_of(kind: str) -> T.StructType:
    return T._parse_datatype_string({"state": STATE, "pairs": PAIRS, "runs": RUNS}[kind])
