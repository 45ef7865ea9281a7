"""Similarity joins on edit distance, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import stash
from .state import numbered

#: Up to so many edits, strings of up to so many characters meet by what is left after deletions; fewer
#: characters where there are as many edits as that, since each string then has many results.
MOST_DELETIONS, MOST_CHARS, FEWER_CHARS = 3, 32, 16
#: A piece that more strings share than this is common: its strings are dealt out in parts.
COMMON, PARTS = 1000, 64
#: Keys in a partition within which strings meet, about; rows and pairs that are held or sent at once.
KEYS, KEY_ROWS, PAIR_ROWS = 2_000_000, 65_536, 1 << 20
#: Blocks of keys that are sent at once.
BLOCKS = 64


def segments(strings: DataFrame, column: str, threshold: int) -> DataFrame:
    """threshold + 1 even pieces of each string: (string, size, piece, part)."""
    n = threshold + 1
    size = F.char_length(column)
    piece = F.explode(F.sequence(F.lit(0), F.lit(threshold)))
    rows = strings.select(F.col(column).alias("string"), size.alias("size"), piece.alias("piece"))
    start = F.floor(F.col("piece") * F.col("size") / n).cast("int")
    stop = F.floor((F.col("piece") + 1) * F.col("size") / n).cast("int")
    return rows.select("string", "size", "piece", F.substring("string", start + 1, stop - start).alias("part"))


def probes(strings: DataFrame, column: str, threshold: int) -> DataFrame:
    """The parts of each string that could equal a piece of one within threshold edits."""
    n = threshold + 1
    own = F.char_length(column)
    rows = strings.select(F.col(column).alias("probe"), own.alias("own"))
    rows = rows.withColumn("size", F.explode(F.sequence(F.greatest(F.col("own") - threshold, F.lit(0)), F.col("own") + threshold)))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(threshold))))
    start = F.floor(F.col("piece") * F.col("size") / n).cast("int")
    stop = F.floor((F.col("piece") + 1) * F.col("size") / n).cast("int")
    rows = rows.withColumn("start", start).withColumn("length", stop - start)
    # if the first intact piece is the k-th, k edits at least lie before it and threshold - k at most
    # after it; so it moved by k places at most, seen from the left, and as many as are left, from the right
    end = F.col("start") + F.col("own") - F.col("size")
    low = F.greatest(F.col("start") - F.col("piece"), end - (threshold - F.col("piece")), F.lit(0))
    high = F.least(F.col("start") + F.col("piece"), end + (threshold - F.col("piece")), F.col("own") - F.col("length"))
    rows = rows.withColumn("low", low).withColumn("high", high).where("low <= high")
    rows = rows.withColumn("at", F.explode(F.sequence("low", "high")))
    return rows.select("probe", "size", "piece", F.expr("substring(probe, at + 1, length)").alias("part")).distinct()


def by_pieces(probe: DataFrame, pieces: DataFrame) -> DataFrame:
    """(probe, string) with an equal piece. The strings of a common piece are dealt out in PARTS, and
    what probes for it goes to each part."""
    key = ["size", "piece", "part"]
    common = pieces.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > COMMON).select(*key, F.lit(PARTS).alias("_parts"))
    common = stash(common, "common-pieces")
    dealt = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.hash("string"), F.lit(PARTS)))
    pieces = pieces.join(common, key, "left").withColumn("_at", dealt)
    places = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    probe = probe.join(common, key, "left").withColumn("_at", F.explode(places))
    return probe.join(pieces, [*key, "_at"]).select("probe", "string")


#: Fixed: an odd base of the hashes of texts, its inverse modulo 2 ** 64, and a multiplier that mixes bits.
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
UNBASE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(BASE)
    return x ^ (x >> np.uint64(31))


def deletion_hashes(codes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): hashes of all that each row of code points becomes by leaving out up to threshold of
    them. A hash is a polynomial in the places of what is left, so that sums over the kept stretches give it.
    Of equal neighbours only the first is left out, or several, so that few results come twice."""
    n, size = codes.shape
    powers = np.concatenate([np.ones(1, np.uint64), np.full(size, BASE, np.uint64)]).cumprod(dtype=np.uint64)
    back = np.full(threshold + 1, UNBASE, np.uint64).cumprod(dtype=np.uint64)
    sums = np.zeros((n, size + 1), np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * powers[:size], axis=1, dtype=np.uint64, out=sums[:, 1:])
    same = np.zeros((n, size), bool)
    same[:, 1:] = codes[:, 1:] == codes[:, :-1]
    rows, keys = [np.arange(n)], [sums[:, size]]
    for count in range(1, min(threshold, size) + 1):
        for first in range(size - count + 1):
            # all choices whose first place is this one: few enough at a time
            left = np.array([(first, *more) for more in combinations(range(first + 1, size), count - 1)])
            kept, start = sums[:, left[:, 0]], left[:, 0] + 1
            fine = np.ones((n, len(left)), bool)
            fine &= ~same[:, [first]]
            for k in range(1, count):
                kept += (sums[:, left[:, k]] - sums[:, start]) * back[k - 1]
                fine &= ~same[:, left[:, k]] | (left[:, k - 1] == left[:, k] - 1)
                start = left[:, k] + 1
            kept += (sums[:, [size]] - sums[:, start]) * back[count - 1]
            row, choice = np.nonzero(fine)
            rows.append(row)
            keys.append(kept[row, choice])
    return np.concatenate(rows), mixed(np.concatenate(keys)).view(np.int64)


def short_chars(threshold: int) -> int:
    return MOST_CHARS if threshold < MOST_DELETIONS else min(MOST_CHARS, FEWER_CHARS)


def deletions(strings: DataFrame, column: str, threshold: int, key: str = "key") -> DataFrame:
    """strings with a row for each key: hashes of all that a string becomes by leaving out up to
    threshold characters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            sizes = np.fromiter(map(len, texts), int, len(texts))
            for size in np.unique(sizes):
                (own,) = np.nonzero(sizes == size)
                codes = np.frombuffer("".join(texts[k] for k in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), size)
                row, keys = deletion_hashes(codes, threshold)
                row = own[row]
                for k in range(0, len(row), KEY_ROWS):
                    columns = batch.take(pa.array(row[k : k + KEY_ROWS])).columns
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(keys[k : k + KEY_ROWS])], [*batch.schema.names, key])

    schema = StructType([*strings.schema.fields, StructField(key, LongType())])
    return strings.mapInArrow(cut, schema)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): the pairs of different ids with an equal key, of rows (key, id) that hold all of each of their
    keys; most of them once. Rows are ordered by key, and met with the next, the next but one, and so on."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not parts:
        return
    keys, ids = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    at, step, found, held = np.arange(len(keys)), 1, [], 0
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at + step] == keys[at]]
        found.append(np.stack([ids[at], ids[at + step]]))
        held, step = held + len(at), step + 1
        if held and (held > PAIR_ROWS or not len(at)):
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            pairs, found, held = pairs[:, pairs[0] != pairs[1]], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def measured(pairs: DataFrame, threshold: int) -> DataFrame:
    """(probe, string, edits) of the distinct pairs within threshold edits. Pairs are measured where they
    meet, as many times as they do: few of them are so near, and only these are dealt out."""
    near = F.abs(F.char_length("probe") - F.char_length("string")) <= threshold
    return pairs.where(near).withColumn("edits", F.levenshtein("probe", "string", threshold)).where("edits >= 0").distinct()


def edit_join(left: DataFrame, left_col: str, right: DataFrame, right_col: str, threshold: int) -> DataFrame:
    """(left_col, right_col, edits) of the distinct strings within threshold edits (code points).

    Candidates meet by equality and are then measured. Short strings and thresholds up to
    MOST_DELETIONS meet where both become the same by leaving out characters, which hardly any others
    do. The rest meets by pieces: of threshold + 1 pieces of a string, threshold edits leave one intact
    and move it little. A piece that very many strings share, such as a common ending, makes many
    candidates; that is why short strings go the other way. Nulls meet nothing.
    """
    a = left.select(left_col).where(F.col(left_col).isNotNull()).distinct()
    b = right.select(right_col).where(F.col(right_col).isNotNull()).distinct()
    met = []
    if threshold <= MOST_DELETIONS:
        most = short_chars(threshold)
        short = [x.where(F.char_length(c) <= most) for x, c in ((a, left_col), (b, right_col))]
        probe = deletions(short[0].select(F.col(left_col).alias("probe")), "probe", threshold)
        # a string has many keys, which the planner's sizes leave out: it would send all keys of a side through the driver
        keys = deletions(short[1].select(F.col(right_col).alias("string")), "string", threshold).hint("merge")
        met.append(probe.join(keys, "key").select("probe", "string"))
        a, b = (x.where(F.char_length(c) > most - threshold) for x, c in ((a, left_col), (b, right_col)))
    met.append(by_pieces(probes(a, left_col, threshold), segments(b, right_col, threshold)))
    pairs = met[0].unionByName(met[-1]) if len(met) > 1 else met[0]
    pairs = measured(pairs, threshold)
    return pairs.select(F.col("probe").alias(left_col), F.col("string").alias(right_col), "edits")


def nearest_join(left: DataFrame, left_col: str, right: DataFrame, right_col: str, threshold: int) -> DataFrame:
    """(left_col, right_col, edits): of what edit_join() finds, at least all that is nearest to each left
    string. Strings meet by fewer edits first, which few do; only those that nothing is so near to meet by
    threshold edits, and only strings about as long as one of them."""
    less = min(threshold, 2)
    left = stash(left.select(left_col).where(F.col(left_col).isNotNull()).distinct(), "nearest-left")
    close = stash(edit_join(left, left_col, right, right_col, less), "nearest")
    if less == threshold:
        return close
    rest = stash(left.join(close, left_col, "left_anti"), "nearest-rest")
    around = F.sequence(F.char_length(left_col) - threshold, F.char_length(left_col) + threshold)
    sizes = rest.select(F.explode(around).alias("_size")).distinct()
    near = right.select(right_col).join(F.broadcast(sizes), F.char_length(right_col) == F.col("_size"), "left_semi")
    return close.unionByName(edit_join(rest, left_col, near, right_col, threshold))


def left_out(codes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, marks), a column for each choice, of all ways to leave out 0, 1 .. most (2 at most) of each row's
    code points. keys are the hashes of what is left, as in deletion_hashes(); marks say how many were left
    out, at which places, and which they were: in bits from 26, 21 and 16, and 8 and 0. Code points from 255 are 255."""
    n, size = codes.shape
    powers = np.concatenate([np.ones(1, np.uint64), np.full(size, BASE, np.uint64)]).cumprod(dtype=np.uint64)
    sums = np.zeros((n, size + 1), np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * powers[:size], axis=1, dtype=np.uint64, out=sums[:, 1:])
    one, two = np.uint64(UNBASE), np.uint64(UNBASE * UNBASE % (1 << 64))
    chars = np.minimum(codes, 255).astype(np.int64)
    yield mixed(sums[:, size:]).view(np.int64), np.zeros((n, 1), np.int64)
    if most > 0 and size > 0:
        p = np.arange(size)
        keys = sums[:, p] + (sums[:, [size]] - sums[:, p + 1]) * one
        yield mixed(keys).view(np.int64), (1 << 26 | p << 21) + (chars << 8)
    if most > 1 and size > 1:
        p, q = np.triu_indices(size, 1)
        keys = sums[:, p] + (sums[:, q] - sums[:, p + 1]) * one + (sums[:, [size]] - sums[:, q + 1]) * two
        yield mixed(keys).view(np.int64), (2 << 26 | p << 21 | q << 16) + (chars[:, p] << 8) + chars[:, q]


def dealt_keys(parts: int, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (id, string, fewer) the keys and marks of left_out(), of one place less where fewer, with the ids put before the marks: as
    blocks (part, keys, marks), so that the exchange carries few and large rows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(), batch.column("string").to_pylist()
            fewer = batch.column("fewer").to_numpy(zero_copy_only=False)
            shape = np.fromiter(map(len, texts), int, len(texts)) * 2 + fewer
            keys, marks = [], []
            for one in np.unique(shape):
                (own,) = np.nonzero(shape == one)
                codes = np.frombuffer("".join(texts[k] for k in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), one // 2)
                for key, mark in left_out(codes, threshold - one % 2):
                    keys.append(key.ravel())
                    marks.append((mark + (ids[own, None] << 28)).ravel())
            if not keys:
                continue
            keys, marks = np.concatenate(keys), np.concatenate(marks)
            part = (keys.view(np.uint64) >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
            keys, marks, part = keys[order], marks[order], part[order]
            found, start = np.unique(part, return_index=True)
            ends = [*start[1:], len(part)]
            for k in range(0, len(found), BLOCKS):
                spans = list(zip(start[k : k + BLOCKS], ends[k : k + BLOCKS]))
                blocks = [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (keys, marks)]
                yield pa.RecordBatch.from_arrays([pa.array(found[k : k + BLOCKS].astype(np.int64)), *blocks], ["part", "keys", "marks"])

    return deal


def within(x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """Whether two strings that become the same by what marks x and y leave out are shown by just these to be within
    threshold edits (1 or 2). Each pair within them is shown so by some marks: what replaces another is left out
    at the same place of both, and differs; what comes in is left out of one. Pairs with less left out show the rest."""
    swap = (x >> 26 & 3) < (y >> 26 & 3)
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    n, m = x >> 26 & 3, y >> 26 & 3
    p, q, r, s = x >> 21 & 31, x >> 16 & 31, y >> 21 & 31, y >> 16 & 31
    differ = lambda a, b: (a != b) | (a == 255)
    first, second = x >> 8 & 255, x & 255
    other, last = y >> 8 & 255, y & 255
    both = (p == r) & (q == s) & differ(first, other) & differ(second, last)
    single = ((r == p) & differ(first, other)) | ((r == q - 1) & differ(second, other))
    ones = (p == r) if threshold < 2 else True
    return np.where(m == 0, True, np.where(m == 2, both, np.where(n == 2, single, ones)))


def met_pairs(threshold: int) -> Callable[[pa.Table], pa.Table]:
    """(a, b), a < b: of the blocks of one part the ids that within() accepts; most of them once. Rows are ordered
    by key, and met with the next, the next but one, and so on."""

    def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, marks = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(c)]) for c in ("keys", "marks"))
        order = np.argsort(keys)
        keys, marks = keys[order], marks[order]
        again = np.zeros(len(keys), bool)
        again[1:] = keys[1:] == keys[:-1]
        again[:-1] |= again[1:]
        keys, marks = keys[again], marks[again]
        for k in range(0, len(keys), PAIR_ROWS):
            at, step = np.arange(k, min(k + PAIR_ROWS, len(keys))), 1
            while len(at):
                at = at[at + step < len(keys)]
                at = at[keys[at + step] == keys[at]]
                x, y = marks[at], marks[at + step]
                fine = within(x, y, threshold)
                x, y = x[fine] >> 28, y[fine] >> 28
                step += 1
                differ = x != y
                if differ.any():
                    x, y = x[differ], y[differ]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return lambda table: pa.Table.from_batches(meet(table), pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def near_ids(short: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b: the ids of the distinct strings of short (id, string, fewer) within threshold edits, and hardly
    any others (equal hashes). Where fewer, only what is left by one deletion less counts for a string."""
    size = F.char_length("string")
    n = short.agg(F.sum(1 + size + (size * (size - 1) / 2 if threshold > 1 else 0) + (size * size * size / 6 if threshold > 2 else 0))).first()[0] or 0
    parts = int(n) // KEYS + 1
    if threshold > 2:
        keys = deletions(short.select("id", "string"), "string", threshold).select("key", "id").repartition(parts, "key")
        return keys.mapInArrow(meetings, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    blocks = short.mapInArrow(dealt_keys(parts, threshold), "part long, keys binary, marks binary")
    return blocks.groupBy("part").applyInArrow(met_pairs(threshold), "a long, b long").distinct()


def pairs_of_ids(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b: the ids of the rows (id, string, fewer) whose strings are within threshold edits, and hardly any
    others. ids are less than 2 ** 35, strings distinct. Candidates meet as in edit_join(), but what a string becomes
    by leaving out characters is made once, and the places of what is left out tell most others."""
    long = rows
    met = []
    if threshold <= MOST_DELETIONS:
        most = short_chars(threshold)
        met.append(near_ids(rows.where(F.char_length("string") <= most), threshold))
        long = rows.where(F.char_length("string") > most - threshold)
    far = by_pieces(probes(long, "string", threshold), segments(long, "string", threshold)).where("probe < string")
    # those of two short strings are met above
    far = measured(far, threshold) if not met else measured(far.where(F.greatest(F.char_length("probe"), F.char_length("string")) > most), threshold)
    name = lambda own, column: long.select(F.col("id").alias(own), F.col("string").alias(column))
    far = far.join(name("x", "probe"), "probe").join(name("y", "string"), "string")
    met.append(far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return met[0].union(met[-1]) if len(met) > 1 else met[0]


def edit_pairs(strings: DataFrame, column: str, threshold: int) -> DataFrame:
    """(probe, string, edits) of the pairs of distinct strings of one table within threshold edits, each
    pair once with probe < string."""
    rows = strings.select(F.col(column).alias("string")).where(F.col(column).isNotNull()).distinct()
    rows = stash(numbered(rows, F.col("string"), name="id").withColumn("fewer", F.lit(False)), "edit-strings")
    name = lambda own, column: rows.select(F.col("id").alias(own), F.col("string").alias(column)).hint("merge")
    pairs = pairs_of_ids(rows, threshold).join(name("a", "probe"), "a").join(name("b", "string"), "b")
    return pairs.select("probe", "string", F.levenshtein("probe", "string", threshold).alias("edits")).where("edits >= 0")
