"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder


def known_labels(labels: DataFrame, label: str, folds: list[int], modulus: int) -> DataFrame:
    return labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & remainder(modulus).isin(folds))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, parts: dict[int, list[int]], modulus: int = 4) -> DataFrame:
    """(part, label, doc_id, text) of at most `most` documents for each part and each label 0 and 1:
    those with the least hash of doc_id among the rows whose crc32(doc_id as text) modulo modulus is in
    the part's folds. Null labels and null ids are left out; a document with several labels has the
    greatest, one that comes several times counts once, with the greatest text."""
    chosen = []
    for part, folds in parts.items():
        known = known_labels(labels, label, folds, modulus).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        for k in (0, 1):
            least = known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            chosen.append(least.select(F.lit(part).alias("part"), "label", "doc_id"))
    ids = chosen[0]
    for more in chosen[1:]:
        ids = ids.unionByName(more)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id")
    return rows.groupBy("part", "label", "doc_id").agg(F.max("text").alias("text"))


#: A text larger than this part of a cap on bytes is taken after all others.
LARGE_PART = 32


def first_rows(sample: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """The rows of a labelled() sample that come first by hash, for each label at most `most` with at
    most most_bytes of text together. Texts over a LARGE_PART-th of most_bytes come last, the smallest
    first, so that they cannot take the place of many; a label's first row stays whatever its size, so
    the cap empties no label."""
    large = F.col("size") > max(1, most_bytes // LARGE_PART)
    by = Window.partitionBy("label").orderBy(large, F.when(large, F.col("size")), F.xxhash64("doc_id"), "doc_id")
    rows = sample.select("label", "doc_id", F.octet_length("text").cast("long").alias("size"))
    so_far = F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = rows.select("label", "doc_id", F.row_number().over(by).alias("place"), so_far.alias("bytes"))
    kept = kept.where((F.col("place") <= most) & ((F.col("bytes") <= most_bytes) | (F.col("place") == 1)))
    return sample.join(F.broadcast(kept.select("label", "doc_id")), ["label", "doc_id"], "left_semi")


def share(labels: DataFrame, label: str, folds: list[int], modulus: int = 4) -> float:
    """The share of label 1 among the labelled rows of these folds; a half where there are none."""
    found = known_labels(labels, label, folds, modulus).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if found is None else float(found)
