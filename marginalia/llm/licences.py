"""Licence notices in texts by a positional index of rare words. DataFrame functions only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stash

#: Fixed: words, after A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The share of a notice's weight that must stand in its place.
LEAST_SHARE = 0.7


@dataclass(frozen=True)
class Notice:
    """The words of a notice, the phrases that its place in a text must hold, and the share of its
    weight that must stand there. Base notices are phrases found word for word."""

    label: str
    text: str
    keys: list[str] = field(default_factory=list)
    share: float = LEAST_SHARE
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


# The phrases of the contract.
BASE = [
    Notice("gpl", "gnu general public license", share=1.0, base=True),
    Notice("apache", "apache license", share=1.0, base=True),
    Notice("cc-by", "cc by", share=1.0, base=True),
    Notice("mit", "mit license", share=1.0, base=True),
]
# Openings of public licence notices.
NOTICES = [
    Notice("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    Notice(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ["apache license"],
    ),
    Notice(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    Notice("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    Notice("cc0", "waived all copyright and related or neighboring rights to this work", ["copyright and related or neighboring rights"]),
    Notice(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ["gnu general public license"],
    ),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    Notice("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    Notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        ["permission is hereby granted free of charge"],
    ),
    Notice("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
]


def words_of(text_col: str = "text") -> Column:
    """The words of a text. Lowering may change what is not ASCII, which no notice holds; but the one
    sign that would become an ASCII letter, the Kelvin sign, is replaced by another first."""
    text = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("K"), F.lit("Å"))
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_weights(docs: DataFrame, notices: list[Notice], text_col: str = "text") -> dict[str, float]:
    """1 + log((rows + 1) / (rows with the word + 1)) of every word of the notices, over all rows. What
    reaches the driver is bounded by the notices."""
    known = sorted({w for notice in notices for w in notice.words})
    held = F.array_intersect(F.lit(known), words_of(text_col))
    # each row counts once under the empty string, so that one pass gives the total too
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w")).groupBy("w").count()
    found = {row["w"]: row["count"] for row in counts.collect()}
    total = found.get("", 0)
    return {w: 1 + math.log((total + 1) / (found.get(w, 0) + 1)) for w in known}


def anchors(notice: Notice, weights: dict[str, float]) -> list[str]:
    """The notice's rarest words, as many as are needed for the others to weigh less than its share: no
    place where enough weight stands is without one."""
    left = sum(weights[w] for w in notice.words)
    least, chosen = notice.share * left - 1e-9, []
    for w in sorted(set(notice.words), key=lambda w: (-weights[w], w)):
        if left < least:
            break
        chosen.append(w)
        left -= notice.words.count(w) * weights[w]
    return chosen


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short list as a table, by the engine's own functions."""
    names = [field.split()[0] for field in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>>")))


def postings(spark: SparkSession, notices: list[Notice], weights: dict[str, float]) -> DataFrame:
    """The index: (word, notice, place, weight, others) for each place of an anchor in a notice.
    Weights are shares of the notice's; others is the weight of all that is no anchor."""
    rows = []
    for number, notice in enumerate(notices):
        total, chosen = sum(weights[w] for w in notice.words), anchors(notice, weights)
        others = sum(weights[w] for w in notice.words if w not in chosen) / total
        rows += [(w, number, k, weights[w] / total, others) for k, w in enumerate(notice.words) if w in chosen]
    return listed(spark, rows, "word string, notice int, place int, weight double, others double")


def patterns(spark: SparkSession, notices: list[Notice], weights: dict[str, float]) -> DataFrame:
    """(notice, label, base, least, own, weights, keys): what a place of a notice is held against."""
    rows = []
    for number, n in enumerate(notices):
        total = sum(weights[w] for w in n.words)
        shares = [weights[w] / total for w in n.words]
        rows.append((number, n.label, n.base, n.share - 1e-9, n.words, shares, [f" {key} " for key in n.keys]))
    names = "notice int, label string, base boolean, least double, own array<string>, weights array<double>, keys array<string>"
    return listed(spark, rows, names)


def licence_places(scanned: DataFrame, notices: list[Notice], weights: dict[str, float]) -> DataFrame:
    """(row, start, label, share, base) of the places of notices in scanned rows (row, words, hits)."""
    spark = scanned.sparkSession
    index, known = postings(spark, notices, weights), patterns(spark, notices, weights)
    longest = max((len(n.words) for n in notices), default=0)
    hits = scanned.where(F.size("hits") > 0).select("row", "words", F.explode("hits").alias("at"))
    begin = lambda at: F.greatest(at + 1 - longest, F.lit(0))
    around = F.slice("words", begin(F.col("at")) + 1, 2 * longest)
    hits = hits.select("row", "at", F.get("words", F.col("at")).alias("word"), around.alias("around"))
    met = hits.join(F.broadcast(index), "word").withColumn("start", F.col("at") - F.col("place"))
    # looked-up words that agree on where the notice starts; their weight says whether the rest can suffice
    met = met.groupBy("row", "notice", "start").agg(F.sum("weight").alias("weight"), F.first("others").alias("others"), F.min(F.struct("at", "around")).alias("near"))
    met = met.join(F.broadcast(known), "notice").where(F.col("weight") + F.col("others") >= F.col("least"))
    # the words where the notice's would be, null before the text begins
    before = F.greatest(-F.col("start"), F.lit(0))
    inside = F.slice("near.around", F.col("start") + before - begin(F.col("near.at")) + 1, F.size("own") - before)
    window = F.concat(F.array_repeat(F.lit(None).cast("string"), before), inside)
    met = met.select("row", "start", "label", "base", "least", "own", "weights", "keys", window.alias("window"))
    stands = F.zip_with(F.zip_with("window", "own", lambda x, y: F.coalesce(x == y, F.lit(False))), "weights", lambda hit, w: F.when(hit, w).otherwise(0.0))
    share = F.least(F.aggregate(stands, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    text = F.concat(F.lit(" "), F.array_join("window", " "), F.lit(" "))
    met = met.select("row", "start", "label", "base", "least", share.alias("share"), F.forall("keys", lambda key: F.contains(text, key)).alias("held"))
    return met.where((F.col("share") >= F.col("least")) & F.col("held")).select("row", "start", "label", "share", "base")


def licence_scan(
    docs: DataFrame,
    text_col: str = "text",
    carry: list[str] | None = None,
    notices: list[Notice] | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """For each row of docs: the columns in carry (all but the text by default), n_words, n_base,
    first_word, last_word, base_labels, labels, score, and places, array<struct<start,label,share,base>>.

    Every text is searched whole. A null or empty text has no words and no places: zeros, null first
    and last word, empty labels and places. Rows that repeat are searched each for itself, null ids make
    no difference, and an empty table gives an empty result. Columns of docs named like an added one
    are replaced.

    Words of notices are weighed by how rare they are among all rows of docs (or by given weights). The
    index holds the rarest of each notice. A file's words are looked up there; those that agree on where
    a notice starts add up, and where their weight can suffice, all its words are compared, and the
    key phrases looked for. Base notices need every word in its place. score is the greatest share of
    a notice's weight that stands in one of its places, 0 without places.

    Texts are read twice and not shuffled: only the words of files with looked-up words are written, and
    only places meet by row. Notices are a list of at most some hundreds, so the index is broadcast.
    """
    notices = BASE + NOTICES if notices is None else notices
    weights = weights or word_weights(docs, notices, text_col)
    kept = [c for c in (carry if carry is not None else docs.columns) if c not in ADDED and (carry is not None or c != text_col)]
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    words = rows.select(*(f"c{docs.columns.index(c)}" for c in kept), words_of(f"c{docs.columns.index(text_col)}").alias("words"))
    rare = F.lit(sorted({w for n in notices for w in anchors(n, weights)}))
    at = F.filter(F.transform("words", lambda w, k: F.when(F.array_contains(rare, w), k)), lambda k: k.isNotNull())
    words = words.withColumn("hits", at)
    scanned = words.select(
        F.monotonically_increasing_id().alias("row"),
        *(c for c in words.columns if c not in ("words", "hits")),
        F.size("words").cast("long").alias("n_words"),
        "hits",
        F.when(F.size("hits") > 0, F.col("words")).alias("words"),
    )
    scanned = stash(scanned, "licence-words")
    places = licence_places(scanned, notices, weights)
    places = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "label", "share", "base"))).alias("places"))
    base = F.filter("places", lambda p: p["base"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: p["label"]))), ",")
    out = scanned.drop("words", "hits").join(places, "row", "left")
    out = out.withColumn("places", F.coalesce("places", F.array().cast("array<struct<start:int,label:string,share:double,base:boolean>>")))
    return out.select(
        *(F.col(f"c{docs.columns.index(c)}").alias(c) for c in kept),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        "places",
    )


ADDED = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"}
