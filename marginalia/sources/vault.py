"""Markdown notes in a folder as a Spark data source, and the writer of planned edits."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import content_hash
from ..session import BATCH_BYTES, BATCH_ROWS, prepare, stash

SCHEMA = "path string, content string, valid_utf8 boolean"
#: Files of one task of a read where the options do not say: in between, a vault is dealt into so many tasks.
FEW_FILES, MANY_FILES, TASKS = 256, 4096, 128


def inside(root: Path, relative: str) -> Path:
    """The file of a note; ValueError if the path leaves the folder."""
    file = (root / relative).resolve()
    if not file.is_relative_to(root.resolve()):
        raise ValueError(f"{relative} is outside of the vault")
    return file


def folded(text: str) -> str:
    """All line ends as line feeds."""
    return text.replace("\r\n", "\n").replace("\r", "\n")


def listed(root: str) -> Iterator[str]:
    """Paths of the notes below a folder, by the entries of its folders alone: no file is looked at."""
    folders = [""]
    while folders:
        folder = folders.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    folders.append(f"{folder}{entry.name}/")
                elif entry.name.endswith(".md") and not entry.name.startswith("."):
                    yield folder + entry.name


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class VaultReader(DataSourceReader):
    def __init__(self, root: str, per_partition: int = 0):
        self.root, self.per_partition = root, per_partition

    def partitions(self) -> list[Files]:
        found = sorted(listed(self.root))
        step = self.per_partition or min(max(FEW_FILES, -(-len(found) // TASKS)), MANY_FILES)
        return [Files(found[k : k + step]) for k in range(0, len(found), step)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in partition.paths:
            with open(os.path.join(self.root, path), "rb") as file:
                raw = file.read()
            try:
                rows.append((path, folded(raw.decode("utf-8")), True))
            except UnicodeDecodeError:
                rows.append((path, folded(raw.decode("utf-8", "replace")), False))
            held += len(raw)
            if len(rows) == BATCH_ROWS or held > BATCH_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple[str, str, bool]]) -> pa.RecordBatch:
    types = {"path": pa.string(), "content": pa.string(), "valid_utf8": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types.values())], list(types))


class Vault(DataSource):
    """Every *.md file below the folder in option path, except those whose name starts with a full
    stop: files in dot folders, names with an underscore and empty files are kept, which Spark's own
    file sources skip. Undecodable files have valid_utf8 false. The folder must be one that executors
    reach too."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VaultReader:
        return VaultReader(self.options["path"], int(self.options.get("filesPerPartition", 0)))


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, valid_utf8, content_hash)."""
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    prepare(spark).dataSource.register(Vault)
    rows = spark.read.format("vault").load(path)
    return rows.withColumn("content_hash", content_hash(rows["content"]))


def write_edits(edits: DataFrame, root: str) -> DataFrame:
    """Writes (path, new_content) into the folder's notes on the executors and returns (path, written)
    as a written table; notes that are gone are not written, nor, where edits have a base_hash, notes
    whose text is another by now: not even by an earlier try of the same task, which counts as
    written. Paths outside of the folder fail."""
    spark = edits.sparkSession
    prepare(spark)
    checked = "base_hash" in edits.columns
    short = lambda text: hashlib.sha256(text.encode()).hexdigest()[:16]

    def put(batches):
        for batch in batches:
            done = []
            for k, (path, text) in enumerate(zip(batch["path"], batch["new_content"])):
                file = inside(Path(root), path)
                if file.exists() and checked:
                    found = folded(file.read_bytes().decode("utf-8", "replace"))
                    if short(found) != batch["base_hash"][k]:
                        done.append(found == folded(text))
                        continue
                if file.exists():
                    beside = file.with_name(f".{file.name}.new")
                    beside.write_bytes(text.encode())
                    os.replace(beside, file)
                done.append(file.exists())
            yield batch[["path"]].assign(written=done)

    columns = ["path", "new_content", *(["base_hash"] if checked else [])]
    return stash(edits.select(*columns).mapInPandas(put, "path string, written boolean"), "written")


def drop_vault(notes: DataFrame, root: str) -> None:
    """Deletes a folder and what is in it. Notes that rows name by path are deleted in tasks; only folders and
    what no row names are left to the driver. Paths outside of the folder fail."""

    def drop(batches):
        for batch in batches:
            for path in batch["path"]:
                inside(Path(root), path).unlink(missing_ok=True)
            yield batch[["path"]]

    notes.select("path").mapInPandas(drop, "path string").count()
    shutil.rmtree(root, ignore_errors=True)
