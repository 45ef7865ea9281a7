"""What the jobs share: notes out of the documents table, arguments, and logging."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import content_hash
from marginalia.session import builder, prepare

log = logging.getLogger("jobs")

#: The columns of documents that the jobs read.
DOCUMENTS = "doc_id long, text string, lang string, source string"


def notes_of(docs: DataFrame, *more: str) -> DataFrame:
    """(path, lang, content, content_hash) and more columns of documents: one note for each, in the folder of its source.
    A null text is empty, a null source or language has a name of its own; rows without an id have a null
    path."""
    lang, folder = F.coalesce("lang", F.lit("xx")), F.coalesce("source", F.lit("unsorted"))
    path = F.concat(folder, F.lit("/"), lang, F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))
    content = F.coalesce("text", F.lit(""))
    return docs.select(path.alias("path"), lang.alias("lang"), content.alias("content"), content_hash(content).alias("content_hash"), *more)


def rows_read(docs: DataFrame) -> dict[str, int]:
    """read and without_id: the rows of documents, and those without an id. Reads the ids alone."""
    return docs.agg(F.count("*").alias("read"), F.count_if(F.col("doc_id").isNull()).alias("without_id")).first().asDict()


def settings(defaults: dict[str, Any], given: dict[str, Any] | None) -> dict[str, Any]:
    """The defaults with what is given put in; unknown names are refused."""
    unknown = set(given or {}) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | (given or {})


def command_line(says: str, work: Callable[..., dict[str, Any]], args: list[str] | None = None, checkpoint: bool = False) -> None:
    """Runs a job's function in a session of its own and prints its counts as JSON."""
    parser = argparse.ArgumentParser(description=says)
    parser.add_argument("--input", required=True, help="folder of the tables")
    parser.add_argument("--output", required=True, help="folder of the result")
    if checkpoint:
        parser.add_argument("--checkpoint", required=True, help="folder of the stream's progress")
    parser.add_argument("--config", help="JSON file of settings")
    parser.add_argument("--master", help="Spark master; that of spark-submit by default")
    given = parser.parse_args(args)
    config = {}
    if given.config:
        with open(given.config, encoding="utf-8") as file:
            config = json.load(file)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = prepare((builder(given.master) if given.master else SparkSession.builder).getOrCreate())
    try:
        places = [given.input, given.output] + ([given.checkpoint] if checkpoint else [])
        print(json.dumps(work(spark, *places, config=config)))
    finally:
        spark.stop()
