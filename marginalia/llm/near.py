"""Near-duplicate components: banded MinHash, odd sketches, and confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.state import numbered
from ..session import stash
from .blocks import text_buffer
from .common import map_arrow, join_groups, slices, text_or_empty, with_filter
from .graph import components
from .shingles import bands, minhash, odd_sketch, shingle_sets, similarity

N_WORDS, PERCENT = 5, 80
#: Bands and samples in each: two sets of similarity 0.8 miss all bands in one of 80,000 cases.
N_BANDS, BAND_ROWS = 48, 7
SKETCH_BITS = 2048
#: How many standard errors below the limit a sketch's estimate may lie before a pair is refused.
ERRORS = 5
#: Members of a bucket that one task compares with as many others.
TILE = 256
#: Documents in a slice.
ROWS = 256


def margin(n_samples: int, percent: int, bits: int = SKETCH_BITS) -> float:
    """The least estimate that goes on to confirmation: ERRORS standard errors below the limit, of the
    samples and of the sketch that folds them. A true pair falls below in one of some millions."""
    limit = percent / 100
    flips = 2 * n_samples * (1 - limit)
    spread = bits / 4 * -np.expm1(-4 * flips / bits)
    slope = 1 / (2 * n_samples * np.exp(-2 * flips / bits))
    return float(limit - ERRORS * np.sqrt(limit * (1 - limit) / n_samples + spread * slope**2))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of ascending distinct values."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first n_keys columns, which are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        head = tuple(key[0] for key in keys)
        if held and head != last:
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, stop in zip(starts, starts[1:]):
            if start and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
        last = tuple(key[-1] for key in keys)
    if held:
        yield pa.Table.from_batches(held)


def tile_links(table: pa.Table, percent: int, least: float, n_samples: int, bits: int) -> list[tuple[int, int]]:
    """Links that join different components among a tile's rows: each row of side 1 against all of
    side 0, and where within is set against the other rows of side 1. Sketches choose the pairs that
    are confirmed on full sets; pairs that earlier links joined need no confirmation."""
    ids = table.column("id").to_numpy()
    side = table.column("side").to_numpy()
    within = bool(table.column("within")[0].as_py())
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    _, comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)
    found = []
    order = np.argsort(side, kind="stable")
    edge = int((side == 0).sum())
    for at in range(edge, len(order)):
        i, others = order[at], order[: at if within else edge]
        others = others[comp[others] != comp[i]]
        if not len(others):
            continue
        guess = similarity(np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1), n_samples, bits)
        likely = np.flatnonzero(guess >= least)
        for j in others[likely[np.argsort(-guess[likely], kind="stable")]]:
            if comp[i] != comp[j] and similar(sets[i], sets[j], percent):
                found.append((int(ids[j]), int(ids[i])))
                comp[comp == comp[i]] = comp[j]
    return found


def set_marks(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """128 bits that tell sets apart, as two rows; zeros for empty sets."""
    marks = np.zeros((2, len(edges) - 1), np.int64)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        for k, odd in enumerate((0x9FB21C651E98DF25, 0xB492B66FBE98F273)):
            own = (codes ^ (codes >> np.uint64(29))) * np.uint64(odd)
            own ^= own >> np.uint64(32)
            marks[k, full] = np.add.reduceat(own * np.uint64(odd), edges[full]).view(np.int64)
    return marks


def further_sets(linkable: DataFrame, above: int) -> DataFrame:
    """(id, mark1, mark2, node) of the sets of ids with several, but for the first of each id: node is a
    number of its own, from above."""
    mark = F.struct("mark1", "mark2")
    several = linkable.groupBy("id").agg(F.min(mark).alias("first"), F.max(mark).alias("last")).where("first <> last")
    several = stash(several.select("id", "first"), "near-several")
    some = with_filter(linkable.select("id", "mark1", "mark2"), several, ["id"]).where("_maybe").drop("_maybe").distinct()
    some = some.join(several, "id").where((F.col("mark1") != F.col("first.mark1")) | (F.col("mark2") != F.col("first.mark2"))).drop("first")
    if not some.take(1):
        return some.withColumn("node", F.col("id"))
    return numbered(some, F.col("id"), F.col("mark1"), F.col("mark2"), name="at").select("id", "mark1", "mark2", (F.col("at") + above).alias("node"))


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = N_WORDS,
    percent: int = PERCENT,
    n_bands: int = N_BANDS,
    band_rows: int = BAND_ROWS,
    bits: int = SKETCH_BITS,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs.

    A document is the set of its distinct n_words-word shingles (A-Z lowered; the whole sequence
    where it is shorter). Two are linked if 100 * intersection >= percent * union, confirmed on full
    sets of 64-bit fingerprints; component_id is the smallest id that links reach, kept says it is
    the row's own. Without words (null, empty or blank texts) nothing is linked. Rows with the same
    id are one document, linked by what any of its texts is linked by; a null id is never linked, has no
    component and is kept. Ids are integers below 2 ** 62. An empty table gives an empty result.

    Equal sets collapse first. MinHash samples give band keys, and parity bitmaps of the samples
    (odd sketches) say which pairs of a bucket to confirm: first every member against the bucket's
    smallest id, then, in buckets that still hold several components, all pairs of different
    components, in tiles of bounded size. Links come back as spanning trees, never as all pairs.
    """
    n_samples = n_bands * band_rows
    least = margin(n_samples, percent, bits)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            raw, bounds = text_buffer(batch.column(1))
            codes, edges = shingle_sets(raw, bounds, n_words)
            n = np.diff(edges)
            samples = minhash(codes, edges, n_samples)
            marks = set_marks(codes, edges)
            keys = pa.array(bands(samples, band_rows).view(np.int64).ravel())
            sketch = odd_sketch(samples, bits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array(marks[0]),
                    pa.array(marks[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * n_bands, pa.int32()), keys),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                ],
                names=["id", "n_shingles", "mark1", "mark2", "keys", "sketch"],
            )

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            codes, edges = shingle_sets(*text_buffer(batch.column(1)), n_words)
            sets = [codes[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            marks = set_marks(codes, edges)
            columns = [batch.column(0), pa.array(marks[0]), pa.array(marks[1]), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark1", "mark2", "shingles"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            links = tile_links(table, percent, least, n_samples, bits)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def links_of(tiles: DataFrame) -> DataFrame:
        """Links within tiles: rows (g1, g2, g3, id, comp, side, within), with sets put beside."""
        rows = tiles.join(sets, "id").repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3")
        columns = ["g1", "g2", "g3", "id", "comp", "side", "within", "sketch", "shingles"]
        return map_arrow(rows.select(*columns), confirm, "a long, b long")

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    schema = "id long, n_shingles long, mark1 long, mark2 long, keys array<long>, sketch binary"
    marked = stash(map_arrow(texts, features, schema), "near-features")
    total, largest = marked.agg(F.count("*"), F.coalesce(F.max("id"), F.lit(0))).first()
    linkable = marked.where("id IS NOT NULL AND n_shingles > 0")

    # a set is compared under its id, or under a node of its own where the id has another set
    further = stash(further_sets(linkable, largest + 1), "near-further")
    any_further = bool(further.take(1))

    def by_node(rows: DataFrame) -> DataFrame:
        """rows (id, mark1, mark2, ...) with the id replaced by the set's node."""
        if not any_further:
            return rows
        rows = with_filter(rows, further, ["id", "mark1", "mark2"])
        some = rows.where("_maybe").drop("_maybe").join(further, ["id", "mark1", "mark2"], "left")
        some = some.withColumn("id", F.coalesce("node", "id")).drop("node")
        return rows.where("NOT _maybe").drop("_maybe").unionByName(some)

    linkable = by_node(linkable)

    # equal sets: one representative each
    same = linkable.groupBy("mark1", "mark2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    same = stash(same, "near-equal")
    maybe = with_filter(linkable.select("id", "mark1", "mark2"), same, ["mark1", "mark2"])
    members = join_groups(maybe.where("_maybe").drop("_maybe"), same, ["mark1", "mark2"], "n", total, "inner")
    members = stash(members.where("id <> rep").select("id", "rep").distinct(), "near-members")
    chosen = with_filter(linkable.select("id", "keys"), members, ["id"])
    again = chosen.where("_maybe").join(members, "id", "left_anti")
    leaders = chosen.where("NOT _maybe").unionByName(again).select("id", "keys")

    # buckets with two members or more, rows that repeat an id being one; those with the same members
    # count once
    repeated = stash(linkable.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "near-repeated")
    rows = with_filter(leaders, repeated, ["id"]).select("id", F.explode("keys").alias("key"), "_maybe")
    rows = rows.where("NOT _maybe").drop("_maybe").unionByName(rows.where("_maybe").drop("_maybe").distinct())
    buckets = stash(rows.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("pivot")).where("m > 1"), "near-buckets")
    rows = with_filter(rows, buckets.select("key"), ["key"]).where("_maybe").drop("_maybe")
    held = stash(join_groups(rows, buckets, ["key"], "m", total, "inner"), "near-rows")
    content = held.groupBy("key", "m", "pivot").agg(F.bit_xor(F.xxhash64("id")).alias("content"))
    distinct = stash(content.groupBy("m", "pivot", "content").agg(F.min("key").alias("key")).select("key", "m"), "near-distinct")
    held = stash(join_groups(held.drop("m"), distinct, ["key"], "m", total, "inner"), "near-held")

    # the full sets of all that share a bucket
    needed = held.select("id").distinct()
    ids = needed if not any_further else needed.unionByName(further.select("id")).distinct()
    some = with_filter(texts.where("id IS NOT NULL"), ids, ["id"]).where("_maybe").drop("_maybe")
    some = some.join(ids.hint("shuffle_hash"), "id", "left_semi")
    some = some if any_further else some.join(members, "id", "left_anti")
    shingles = map_arrow(some.select("id", "text"), full_sets, "id long, mark1 long, mark2 long, shingles binary").where("length(shingles) > 0")
    shingles = by_node(shingles).select("id", "shingles")
    sketches = linkable.select("id", "sketch")
    sketches = with_filter(sketches, needed, ["id"]).where("_maybe").drop("_maybe")
    sets = stash(shingles.join(sketches, "id").dropDuplicates(["id"]), "near-sets")

    # every member against its bucket's smallest id, some members to a group
    pairs = held.where("id <> pivot").select("pivot", "id").distinct()
    pairs = stash(pairs, "near-pairs")
    sizes = pairs.groupBy("pivot").agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("c") / TILE)
    pairs = join_groups(pairs, sizes, ["pivot"], "c", total, "inner")
    tile = [F.col("pivot").alias("g1"), F.pmod(F.xxhash64("id"), parts).alias("g2"), F.lit(-1).cast("long").alias("g3")]
    no = F.lit(False).alias("within")
    spokes = pairs.select(*tile, "id", F.col("id").alias("comp"), F.lit(1).alias("side"), no)
    hubs = sizes.select(F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("g2"))
    hubs = hubs.select(F.col("id").alias("g1"), "g2", F.lit(-1).cast("long").alias("g3"), "id", F.col("id").alias("comp"), F.lit(0).alias("side"), no)
    links = links_of(spokes.unionByName(hubs))
    if any_further:
        # the sets of one id are one document
        reps = members.select(F.col("id").alias("x"), "rep")
        same_id = further.select(F.col("id").alias("a"), F.col("node").alias("b"))
        for end in ("a", "b"):
            same_id = same_id.join(reps, same_id[end] == reps["x"], "left").withColumn(end, F.coalesce("rep", end)).drop("x", "rep")
        links = links.unionByName(same_id)
    links = stash(links, "near-links")
    labels = components(links)

    # what is left: buckets that still hold several components, in tiles
    mine = labels.select("id", "comp")
    held = held.join(mine, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    pivots = mine.select(F.col("id").alias("pivot"), F.col("comp").alias("main"))
    held = held.join(pivots, "pivot", "left").withColumn("main", F.coalesce("main", "pivot"))
    held = stash(held.select("key", "m", "id", "comp", (F.col("comp") == F.col("main")).alias("inner")), "near-open")
    sizes = held.groupBy("key").agg(
        F.count_if("inner").alias("n_inner"), F.count_if(~F.col("inner")).alias("n_outer"), F.first("m").alias("m")
    ).where("n_outer > 0")
    sizes = sizes.select("key", "m", F.ceil(F.col("n_inner") / TILE).alias("t_in"), F.ceil(F.col("n_outer") / TILE).alias("t_out"))
    open_rows = join_groups(held.drop("m"), stash(sizes, "near-sizes"), ["key"], "m", total, "inner")
    spot = F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("t_in")).otherwise(F.col("t_out")))
    open_rows = open_rows.withColumn("spot", spot)
    # outer tile f with inner tile l is (f, -1 - l); outer tiles f <= g are (f, g)
    inner = open_rows.where("inner").withColumn("g2", F.explode(F.expr("sequence(0L, t_out - 1)")))
    inner = inner.select("key", "g2", (-1 - F.col("spot")).alias("g3"), "id", "comp", F.lit(0).alias("side"), no)
    outer = open_rows.where("NOT inner").withColumn("other", F.explode(F.expr("sequence(-t_in, t_out - 1)")))
    crossing = F.col("other") < 0
    outer = outer.select(
        "key",
        F.when(crossing, F.col("spot")).otherwise(F.least("spot", "other")).alias("g2"),
        F.when(crossing, F.col("other")).otherwise(F.greatest("spot", "other")).alias("g3"),
        "id",
        "comp",
        F.when(crossing | (F.col("spot") == F.col("other")) | (F.col("spot") > F.col("other")), F.lit(1)).otherwise(F.lit(0)).alias("side"),
        (F.col("spot") == F.col("other")).alias("within"),
    )
    tiles = inner.unionByName(outer).withColumnRenamed("key", "g1")
    more = stash(links_of(tiles), "near-more")
    if more.take(1):
        labels = components(links.unionByName(more))

    # every document: its representative's component
    whole = marked.select("id", "n_shingles")
    whole = whole.join(members, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    whole = stash(whole, "near-whole")
    copies = whole.groupBy("rep").agg(F.count("*").alias("size"))
    labels = labels.select(F.col("id").alias("rep"), "comp").join(copies, "rep")
    out = join_groups(whole.where("id IS NOT NULL"), stash(labels, "near-labels"), ["rep"], "size", total)
    out = out.unionByName(whole.where("id IS NULL"), allowMissingColumns=True)
    comp = F.coalesce("comp", "rep")
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles", comp.alias("component_id"), comp.eqNullSafe(F.col("id")).alias("kept")
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that near_components() keeps: one document of each component, whole."""
    dropped = stash(near_components(docs, id_col, text_col, **how).where("NOT kept").select(F.col(id_col)), "near-dropped")
    return docs.join(dropped.distinct().hint("shuffle_hash"), id_col, "left_anti")
