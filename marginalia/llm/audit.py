"""How five quality filters interact: counts of failure masks by Walsh-Hadamard sums, and every order
of the filters evaluated on them."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_paths, recording, stash
from .common import join_groups, text_or_empty

#: Fixed: the letters of the filters; letter k is bit k of a mask.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Fixed: words are maximal runs of what is not white space.
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"


def bits(*failed: Column) -> Column:
    """A mask of conditions, the first being bit 0."""
    out = F.lit(0)
    for k, condition in enumerate(failed):
        out = out + F.when(condition, F.lit(1 << k)).otherwise(F.lit(0))
    return out


def sign(x: Column, y: Column) -> Column:
    """The Walsh function: 1 where x and y share an even number of bits, else -1."""
    return F.lit(1).cast("long") - 2 * (F.bit_count(x.bitwiseAND(y)) % 2)


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) for each row of docs. Only a hash of each text is shuffled; of the groups of
    equal texts, those that hold a large share of the rows are broadcast."""
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text")
    )
    words = texts.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    own = bits(
        n < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * n,
        100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.length("text"),
        F.col("text").rlike(SIGNS),
    )
    marked = words.select("id", "part", own.alias("own"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha"))
    marked = stash(marked, "audit-marks")
    groups = marked.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = stash(groups.where("n > 1"), "audit-copies")
    copies = join_groups(marked, groups, ["sha"], "n", marked.count())
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return copies.select("id", "part", (F.col("own") + F.when(again, F.lit(16)).otherwise(F.lit(0))).alias("mask"))


def parity_sums(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, good, toxic, sums): for the rows of each part and label, the 32 sums of the Walsh functions
    of their masks. Equal rows are counted before they are joined and again before they are shuffled."""
    counted = masks.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    rows = counted.join(known, "id", "left")
    rows = rows.groupBy("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    signed = [F.sum(F.col("n") * sign(F.col("mask"), F.lit(s))).alias(f"s{s}") for s in range(MASKS)]
    return rows.agg(*signed).select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(MASKS))).alias("sums"))


def inverted(sums: Column) -> Column:
    """The counts of the 32 masks from their Walsh sums, exactly: the transform is its own inverse but
    for a factor of 32."""
    index = F.sequence(F.lit(0), F.lit(MASKS - 1))
    term = lambda m: F.zip_with(sums, index, lambda x, s: x * sign(m, s))
    total = lambda m: F.aggregate(term(m), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.transform(index, lambda m: F.shiftright(total(m), MASKS.bit_length() - 1))


def mask_cells(sums: DataFrame) -> DataFrame:
    """(part, n_every, n_good, n_toxic): arrays of the rows with each mask, by the labels."""
    cells = sums.select("part", "good", "toxic", F.posexplode(inverted(F.col("sums"))).alias("mask", "n"))
    groups = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    of = lambda k, group: F.sum(F.when((F.col("mask") == k) & group, F.col("n")).otherwise(0))
    wide = [F.array(*(of(k, group) for k in range(MASKS))).alias(f"n_{name}") for name, group in groups.items()]
    return cells.groupBy("part").agg(*wide)


def over_masks(cells: str, counts, weight=None) -> Column:
    """The sum of an array of cells over the masks for which counts(mask) holds, with a weight."""
    picked = F.transform(cells, lambda n, m: F.when(counts(m), n * weight(m) if weight else n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, b: a + b)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, each of the 120 orders of the five filters, and each step: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document fails A with under 200 words, B if under half of its words are distinct, C if over 2 in
    100 of its code points are A-Z, D with any of #$%&*|, E if a smaller id has the same text. Null texts
    count as empty, null parts as the empty string. A null id is no copy and has no label; rows that
    repeat id and text are no copies of each other, and each counts. A document with several labels has
    quality or toxic 1 if any of its labels does. Without labels nothing is lost. An empty table gives
    an empty result. Other columns are not read.

    The 32 Walsh sums of each part and label give the counts of all masks exactly. A filter removes first
    in 120 / f of the orders where a document fails f filters, so shapley needs no order at all.
    """
    with recording() as paths:
        masks = failure_masks(docs, id_col, text_col, part_col)
    cells = stash(mask_cells(parity_sums(masks, labels, id_col)), "audit-cells")
    drop_paths(docs.sparkSession, paths)
    orders = F.lit(["".join(order) for order in permutations(FILTERS)])
    steps = cells.withColumn("filter_order", F.explode(orders))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit_of = lambda letter: F.pow(F.lit(2), F.ascii(letter) - ord(FILTERS[0])).cast("int")
    letters = F.filter(F.split("filter_order", ""), lambda x: x != "")
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + bit_of(x))
    steps = steps.withColumn("own", bit_of(F.get(letters, F.col("step") - 1))).withColumn("before", before)
    own, before = F.col("own"), F.col("before")
    meets = lambda m, b: m.bitwiseAND(b) != 0
    removed = lambda m: meets(m, own) & ~meets(m, before)
    return steps.select(
        "part",
        "filter_order",
        "step",
        over_masks("n_every", lambda m: ~meets(m, before + own)).alias("kept"),
        over_masks("n_every", removed).alias("removed"),
        over_masks("n_every", lambda m: meets(m, own) & meets(m, before)).alias("redundant"),
        over_masks("n_every", lambda m: m == own).alias("unique_fails"),
        over_masks("n_good", removed).alias("good_lost"),
        over_masks("n_toxic", removed).alias("toxic_lost"),
        over_masks("n_every", lambda m: meets(m, own), lambda m: (120 / F.bit_count(m)).cast("long")).alias("shapley"),
    )
