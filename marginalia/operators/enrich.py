"""Model replies: parsing, and enrichment and verdicts by a pluggable client."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview, without_fence

REPLY = "struct<tags:array<string>,links:array<struct<target:string,reason:string>>,summary:string,_bad:string>"
VERDICT = "struct<should_link:string,reason:string,link_from:string,link_to:string,_bad:string>"


class Enricher(Protocol):
    """Gives a reply (JSON text, possibly in a code fence) for a note."""

    def enrich(self, path: str, content: str) -> str: ...


class Verifier(Protocol):
    """Gives a verdict (JSON text) for a pair of notes and their shared tags."""

    def verify(self, pair: dict) -> str: ...


class FrequentWords:
    """The deterministic default: the most frequent long words are the tags, no links."""

    def __init__(self, most: int = 6, least_chars: int = 7):
        self.most, self.least_chars = most, least_chars

    def enrich(self, path: str, content: str) -> str:
        kept = lambda w: "".join(c for c in w if "a" <= c <= "z")
        counts = Counter(w for w in map(kept, content.lower().split()) if len(w) >= self.least_chars)
        tags = sorted(counts, key=lambda w: (-counts[w], w))[: self.most]
        return json.dumps({"tags": tags, "links": [], "summary": ""})


class SharedTags:
    """The deterministic default verdict: yes from least shared tags on."""

    def __init__(self, least: int = 2):
        self.least = least

    def verify(self, pair: dict) -> str:
        shared = list(pair["shared"])
        yes = len(shared) >= self.least
        return json.dumps({"should_link": yes, "reason": "shared tags: " + ", ".join(shared), "link_from": pair["note_a"], "link_to": pair["note_b"]})


def parsed_replies(replies: DataFrame) -> DataFrame:
    """replies (with column reply) and proposed_tags, proposed_links, summary and ok: whether the reply is
    a JSON object that is not empty. Other replies are errors."""
    text = without_fence(F.col("reply"))
    row = F.from_json(text, REPLY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = replies.withColumn("_text", text).withColumn("_row", row)
    object_like = F.col("_text").rlike(r"(?s)^\{.*\}$") & ~F.col("_text").rlike(r"(?s)^\{\s*\}$")
    return rows.select(
        *replies.columns,
        F.coalesce("_row.tags", F.array().cast("array<string>")).alias("proposed_tags"),
        F.coalesce("_row.links", F.array().cast("array<struct<target:string,reason:string>>")).alias("proposed_links"),
        F.col("_row.summary").alias("summary"),
        (F.coalesce(object_like, F.lit(False)) & F.col("_row._bad").isNull() & F.col("_row").isNotNull()).alias("ok"),
    )


def parsed_verdicts(replies: DataFrame) -> DataFrame:
    """replies (with column reply) and reason, link_from, link_to and confirmed: should_link is anything
    but false, null, 0 or empty."""
    text = without_fence(F.col("reply"))
    row = F.from_json(text, VERDICT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    said = F.try_variant_get(F.try_parse_json(text), "$.should_link", "variant")
    kind, value = F.schema_of_variant(said), F.try_variant_get(said, "$", "string")
    # a string is true unless it is empty, also "false"
    yes = (
        F.when(kind == "STRING", value != "")
        .when(kind == "BOOLEAN", value == "true")
        .when(kind == "VOID", F.lit(False))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.coalesce(F.to_json(said), F.lit("")).isin("", "[]", "{}"))
        .otherwise(F.coalesce(value.try_cast("double") != 0, F.lit(False)))
    )
    rows = replies.withColumn("_row", row).withColumn("_yes", yes)
    return rows.select(
        *replies.columns,
        F.coalesce("_row.reason", F.lit("")).alias("reason"),
        F.col("_row.link_from").alias("link_from"),
        F.col("_row.link_to").alias("link_to"),
        (F.col("_row._bad").isNull() & F.col("_row").isNotNull() & F.coalesce("_yes", F.lit(False))).alias("confirmed"),
    )


def asked(ask, *what) -> tuple[str | None, str | None]:
    """The reply, or what went wrong: one lost answer does not undo those before it."""
    try:
        return ask(*what), None
    except Exception as error:  # noqa: BLE001  whatever the client or its server does
        return None, f"{type(error).__name__}: {error}"


def enriched(notes: DataFrame, client: Enricher) -> DataFrame:
    """(path, content_hash, reply, failure): the client's reply for each note, in batches on the executors;
    where it fails, null and why. Write it before it is read twice: each read asks the client again."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [asked(client.enrich, path, text) for path, text in zip(batch["path"], batch["content"])]
            yield batch[["path", "content_hash"]].assign(reply=[x for x, _ in said], failure=[x for _, x in said])

    return notes.select("path", "content", "content_hash").mapInPandas(ask, "path string, content_hash string, reply string, failure string")


def verified(pairs: DataFrame, notes: DataFrame, states: DataFrame, client: Verifier) -> DataFrame:
    """pairs with the client's reply on the notes' tags and first characters, null where a note is gone,
    failed: whether asking failed, and failure: why."""
    columns = pairs.columns
    rows = pairs
    for side in ("a", "b"):
        texts = notes.select(F.col("path").alias(f"note_{side}"), preview(F.col("content")).alias(f"preview_{side}"))
        tags = states.select(F.col("path").alias(f"note_{side}"), F.col("proposed_tags").alias(f"tags_{side}"))
        rows = rows.join(texts, f"note_{side}", "left").join(tags, f"note_{side}", "left")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = batch["preview_a"].isna() | batch["preview_b"].isna()
            said = [(None, None) if lost else asked(client.verify, pair) for lost, pair in zip(gone, batch.to_dict("records"))]
            replies = [x for x, _ in said]
            lost = [x is None and not none for none, x in zip(gone, replies)]
            yield batch[columns].assign(reply=replies, failed=lost, failure=[x for _, x in said])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return rows.mapInPandas(ask, f"{schema}, reply string, failed boolean, failure string")
