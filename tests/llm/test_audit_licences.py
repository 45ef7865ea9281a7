"""Filter audit and licence scan against plain Python that shares no code with them."""

import math
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from marginalia.llm import audit, licences

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files, to deal in the Software without restriction"
)


# filter audit


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def plain_audit(docs, labels):
    first, yes = {}, {"quality": set(), "toxic": set()}
    for k, text, _ in docs:
        if k is not None:
            first[text or ""] = min(k, first.get(text or "", k))
    for k, quality, toxic in labels:
        yes["quality"] |= {k} if quality == 1 and k is not None else set()
        yes["toxic"] |= {k} if toxic == 1 and k is not None else set()
    failed = []
    for k, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            any(c in "#$%&*|" for c in text),
            k is not None and k > first[text],
        ]
        failed.append((k, part or "", {c for c, bad in zip("ABCDE", tests) if bad}))
    out = {}
    for part in {p for _, p, _ in failed}:
        mine = [(k, f) for k, p, f in failed if p == part]
        removed = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                here = [(k, f) for k, f in left if c in f]
                left = [(k, f) for k, f in left if c not in f]
                removed[c] += len(here)
                fails, alone = sum(c in f for _, f in mine), sum(f == {c} for _, f in mine)
                lost = [sum(k in yes[x] for k, _ in here) for x in ("quality", "toxic")]
                out[part, order, step] = [len(left), len(here), fails - len(here), alone, *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in rows_of(df)}
    assert len(found) == df.count()
    return found


def test_audit_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (2, None, None), (6, 1, 1), (7, 0, 1), (9, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )
    parts = awkward.withColumn("source", F.when(F.col("doc_id") < 8, F.col("source")).when(F.col("doc_id") == 8, F.lit("")))
    docs = [(r["doc_id"], r["text"], r["source"]) for r in parts.collect()]
    want = plain_audit(docs, [tuple(r) for r in labels.collect()])
    assert audited(audit.filter_audit(parts, labels)) == want
    assert {p for p, _, _ in want} == {"s", ""}
    bare = audited(audit.filter_audit(parts, labels.limit(0)))
    assert all(row[4] == row[5] == 0 for row in bare.values()) and {k: v[:4] for k, v in bare.items()} == {k: v[:4] for k, v in want.items()}
    assert audit.filter_audit(nothing, labels).count() == 0


def test_audit_with_every_mask(spark):
    """Texts made to fail each of the 16 masks of A to D, most of them several times over."""
    texts = []
    for mask in range(16):
        n = 50 if mask & 1 else 300
        words = ["same"] * n if mask & 2 else [f"word{k}" for k in range(n)]
        words += ["CAPITALS" * 40] if mask & 4 else []
        words += ["#"] if mask & 8 else []
        texts += [" ".join(words)] * (1 + mask % 3)
    docs = [(k, t, f"p{k % 2}") for k, t in enumerate(texts)]
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, len(docs), 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = audited(audit.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert found == plain_audit(docs, labels)
    masks = {r["mask"] for r in audit.failure_masks(df).collect()}
    assert {m & 15 for m in masks} == set(range(16)) and any(m & 16 for m in masks)


def test_audit_with_one_large_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("own "), "id")).alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    last = {r["filter_order"]: r for r in audit.filter_audit(docs, labels).where("step = 1").collect()}["EABCD"]
    assert (last["removed"], last["kept"], last["unique_fails"]) == (999, 2001, 0)


def test_sums_invert_exactly(spark):
    counts = [(7 * k * k + 3 * k) % 101 for k in range(32)]
    masks = spark.createDataFrame([(k, "p", k) for k, n in enumerate(counts) for _ in range(n)], "id long, part string, mask int")
    sums = audit.parity_sums(masks, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    signed = [sum(n * (-1) ** bin(m & s).count("1") for m, n in enumerate(counts)) for s in range(32)]
    assert sums.first()["sums"] == signed
    assert audit.mask_cells(sums).first()["n_every"] == counts


# licence scan


def plain_scan(texts, notices):
    """All starts of all notices in all texts."""
    lowered = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    words = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t) for t in lowered]
    held = Counter(w for own in words for w in set(own))
    weight = lambda w: 1 + math.log((len(texts) + 1) / (held[w] + 1))
    out = []
    for own in words:
        base, labels, best, firsts = set(), set(), 0.0, []
        for notice in notices:
            size, total = len(notice.words), sum(map(weight, notice.words))
            for start in range(-size + 1, len(own)):
                there = [(own[start + k] if 0 <= start + k < len(own) else None) for k in range(size)]
                share = sum(weight(a) for a, b in zip(notice.words, there) if a == b) / total
                inside = " " + " ".join(x for x in there if x is not None) + " "
                if share >= notice.share - 1e-9 and all(f" {key} " in inside for key in notice.keys):
                    labels.add(notice.label)
                    best = max(best, share)
                    if notice.base:
                        base.add(notice.label)
                        firsts.append(start)
        out.append((len(own), len(firsts), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(best, 9)))
    return out


def scanned(df):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    return [(*(r[c] for c in names), round(r["score"], 9)) for r in rows_of(df)]


NOTICED = [
    "Released under the MIT License, or the Apache License; mit license.",
    "MIT-License mit\nlicense MIT licenses mitlicense MIT  license",
    MIT,
    MIT.replace("hereby granted", "hereby  Granted").replace("documentation", "data"),
    MIT.split(" ", 3)[3],
    "a permission is granted free of charge to any person obtaining a copy of this software",
    "licensed under CC BY-NC 4.0 and CC BY-SA, also CC BY",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by",
    "GNU General Public Licence, GNU general public license, the GNU Lesser General Public License under the terms of the",
    "apacKe license aPACHE lICENSE K",
    "license " * 50 + "mit " * 40 + "license",
    None,
    "",
]


def test_scan_against_all_places(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(NOTICED)], "doc_id long, text string")
    found = licences.licence_scan(df)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    want = plain_scan(NOTICED, licences.BASE + licences.NOTICES)
    assert scanned(found.orderBy("doc_id")) == want
    assert {"cc-by-nc", "mit", "gpl"} <= {x for row in want for x in row[5].split(",")}
    assert want[9][1] == 1 and want[10][1] == 1 and want[11] == want[12] == (0, 0, None, None, "", "", 0.0)
    places = found.where("doc_id = 0").first()["places"]
    assert [(p["start"], p["label"]) for p in places if p["base"]] == [(3, "mit"), (7, "apache"), (9, "mit")]


def test_scan_of_awkward_rows(awkward, nothing):
    rows = awkward.withColumn("text", F.concat("text", F.lit(" CC BY"))).withColumn("labels", F.lit("own"))
    found = licences.licence_scan(rows)
    assert len(set(found.columns)) == len(found.columns) and set(rows.columns) - {"text"} <= set(found.columns)
    texts = [r["text"] for r in rows.collect()]
    assert sorted(scanned(found), key=repr) == sorted(plain_scan(texts, licences.BASE + licences.NOTICES), key=repr)
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter(r["doc_id"] for r in found.collect())
    assert licences.licence_scan(nothing).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.6, 0.95, 1.0])
def test_anchors_miss_no_place(spark, share):
    notices = [licences.Notice("x", "to be or not to be that is the question", share=share), licences.Notice("y", "be that as it may", ["it may"], share)]
    texts = ["to be or not", "that is the question", "be that is as it may be", "or to be not that is question", "may be that as it may", "it may", "question the"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert scanned(licences.licence_scan(df, notices=notices).orderBy("doc_id")) == plain_scan(texts, notices)


def test_scan_stays_in_the_engine(spark, tmp_path):
    spark.range(1).selectExpr("id AS doc_id", "'mit license' AS text").write.parquet(f"{tmp_path}/docs")
    found = licences.licence_scan(spark.read.parquet(f"{tmp_path}/docs"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|Cartesian|NestedLoop", plan)
