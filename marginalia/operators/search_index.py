"""A written index of notes by the trigrams of their lines, for searches that should not read all notes.

The texts that a pattern cannot match without are cut into trigrams; only notes that have the rarest
of these are read, and their lines are matched by the pattern itself. A pattern without such texts, or
with common ones only, is matched against all notes.

Three Parquet tables lie in the index's folder: postings (part, gram, notes), in folders by a hash
of the gram; grams (gram, n), how many notes have each, and how many notes there are under the empty gram; and
notes, in folders by a hash of the path. Grams are of printable ASCII, so there are at most 95 ** 3.
"""

from __future__ import annotations

import re
import string
import uuid
import zlib
from collections.abc import Iterator
from re import _constants as ops
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, stash, unstash
from .search import MOST_LINES, java_pattern, search, search_lines

GRAM = 3
#: Folders of the postings, and of the notes.
FOLDERS = 64
#: Grams of a pattern whose postings are read: the rarest.
MOST_GRAMS = 3
#: A gram in more than this share of the notes narrows no search.
LARGEST_SHARE = 0.2
#: Fixed: the characters outside of ASCII that a pattern takes for an ASCII letter when case is ignored.
ALIKE = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
_FROM = string.ascii_uppercase + "".join(ALIKE)
_TO = string.ascii_lowercase + "".join(ALIKE.values())


def folded(text: str) -> str:
    return text.translate(str.maketrans(_FROM, _TO))


def required_texts(query: str) -> list[str]:
    """Texts that whatever matches the pattern holds, each in one piece. Alternatives, classes and
    what may be missing give none."""
    runs = [""]

    def walk(items) -> None:
        for op, value in items:
            if op is ops.LITERAL:
                runs[-1] += chr(value)
            elif op is ops.SUBPATTERN:
                walk(value[3])
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] > 0:
                runs.append("")
                walk(value[2])
                runs.append("")
            elif op is not ops.AT:
                runs.append("")

    walk(_parser.parse(query, re.IGNORECASE))
    return [run for run in runs if run]


def required_grams(spark: SparkSession, query: str) -> list[str]:
    """The trigrams of a search's texts, folded; a query that is no pattern is a text itself."""
    pattern = query if java_pattern(spark, query) == "(?iu)" + query else re.escape(query)
    found = {run[k : k + GRAM] for run in map(folded, required_texts(pattern)) for k in range(len(run) - GRAM + 1)}
    return sorted(x for x in found if all(" " <= c <= "~" for c in x))


def gram_part(gram: str) -> int:
    return zlib.crc32(gram.encode()) % FOLDERS


#: Fixed: what each code point is in a gram, folded; 0 if it is in none. All above the last one are in none.
CODES = np.zeros(max(map(ord, ALIKE)) + 2, np.int64)
CODES[0x20:0x7F] = [ord(folded(chr(c))) for c in range(0x20, 0x7F)]
CODES[[ord(c) for c in ALIKE]] = [ord(c) for c in ALIKE.values()]
#: Pairs of a gram and a note that a task holds until it sends a block of postings.
BLOCK = 4_000_000


def note_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row): the distinct trigrams of printable ASCII of each text, folded, as numbers of three bytes. None
    crosses a line's end, as no line end is printable ASCII."""
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    points = np.frombuffer("".join(x + "\n" for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = CODES[np.minimum(points, len(CODES) - 1)]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    (at,) = np.nonzero((a > 0) & (b > 0) & (c > 0))
    rows = np.repeat(np.arange(len(texts)), sizes)[at]
    found = np.unique(rows << 24 | a[at] << 16 | b[at] << 8 | c[at])
    return found & 0xFFFFFF, found >> 24


def posting_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, part, notes) of rows (note, content): a row for each gram of some BLOCK pairs."""
    grams, notes, held = [], [], 0

    def block() -> pa.RecordBatch:
        gram, note = np.concatenate(grams), np.concatenate(notes)
        order = np.lexsort((note, gram))
        own, starts = np.unique(gram[order], return_index=True)
        names = [bytes((x >> 16, x >> 8 & 255, x & 255)).decode() for x in own.tolist()]
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gram)), pa.int32()), pa.array(note[order]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(map(gram_part, names), pa.int32()), lists], ["gram", "part", "notes"])

    for batch in batches:
        gram, row = note_grams([x or "" for x in batch.column(1).to_pylist()])
        grams.append(gram)
        notes.append(batch.column(0).to_numpy()[row])
        held += len(gram)
        if held > BLOCK:
            yield block()
            grams, notes, held = [], [], 0
    if held:
        yield block()


def note_key(path: Column) -> Column:
    """A path's hash: two paths of one hash are only candidates of the same searches."""
    return F.xxhash64(path)


class SearchIndex:
    """Searches of the notes that build() wrote: the same rows as operators.search gives for them.

    A null text and an empty table match nothing. Paths that occur twice are found twice, as by a scan.
    Notes that change later are not seen until the index is built again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, notes: DataFrame, folder: str | None = None) -> SearchIndex:
        """Writes the index of notes (path, content, maybe valid_utf8) into a new folder. A note's grams are
        distinct in it; what is shuffled is blocks of notes of a gram."""
        spark = notes.sparkSession
        folder = folder or f"{shared_dir(spark)}/tables/search-index-{uuid.uuid4().hex[:12]}"
        valid = F.col("valid_utf8") if "valid_utf8" in notes.columns else F.lit(True)
        keyed = notes.select("path", "content", valid.alias("valid_utf8"), note_key(F.col("path")).alias("note"))
        keyed = stash(keyed.withColumn("part", F.pmod("note", F.lit(FOLDERS)).cast("int")), "search-notes")
        keyed.repartitionByRange("part", "note").sortWithinPartitions("part", "note").write.partitionBy("part").parquet(f"{folder}/notes")
        held = stash(keyed.select("note", "content").mapInArrow(posting_blocks, "gram string, part int, notes array<long>"), "search-grams")
        held.repartitionByRange("part", "gram").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{folder}/postings")
        total = keyed.agg(F.lit("").alias("gram"), F.count("*").alias("n"))
        held.groupBy("gram").agg(F.sum(F.size("notes")).alias("n")).unionByName(total).coalesce(1).sortWithinPartitions("gram").write.parquet(f"{folder}/grams")
        unstash(keyed, held)
        return cls(spark, folder)

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def notes(self) -> DataFrame:
        return self.table("notes", "path string, content string, valid_utf8 boolean, note long, part int")

    def rarest(self, query: str) -> list[str] | None:
        """The grams to look up: none of them if every note must be read, and None if no note can match."""
        grams = required_grams(self.spark, query)
        counts = {r["gram"]: r["n"] for r in self.table("grams", "gram string, n long").where(F.col("gram").isin(["", *grams])).collect()}
        if any(gram not in counts for gram in grams):
            return None
        few = sorted((counts[gram], gram) for gram in grams if counts[gram] <= LARGEST_SHARE * counts[""])
        return [gram for _, gram in few[:MOST_GRAMS]]

    def candidates(self, query: str) -> DataFrame:
        """The notes that may match, read from the folders that hold any: their numbers, at most FOLDERS
        of them, are all that the driver learns of the notes."""
        grams = self.rarest(query)
        if grams is None:
            return self.notes().where(F.lit(False))
        if not grams:
            return self.notes()
        postings = self.table("postings", "gram string, notes array<long>, part int")
        found = postings.where(F.col("part").isin(sorted(set(map(gram_part, grams)))) & F.col("gram").isin(grams))
        found = found.select("gram", F.explode("notes").alias("note")).distinct()
        found = found.groupBy("note").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("note")
        parts = [r[0] for r in found.select(F.pmod("note", F.lit(FOLDERS)).cast("int")).distinct().collect()]
        return self.notes().where(F.col("part").isin(parts)).join(found, "note", "left_semi")

    def search_lines(self, query: str) -> DataFrame:
        return search_lines(self.candidates(query).drop("note", "part"), query)

    def search(self, query: str, most: int = MOST_LINES) -> DataFrame:
        return search(self.candidates(query).drop("note", "part"), query, most)
