"""The note tools a model may call, as texts: over a notes DataFrame on the driver, or over a written
snapshot on executors."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import frontmatter, inline_tags, is_hidden, lines, outgoing_links, sort_key
from ..operators.edit_log import EDITS, edit_applied, edit_error, with_edits
from ..operators.links import backlinks
from ..operators.search import MOST_LINES, hashed, list_notes, search
from ..session import shared_dir

_PATH = {"path": ("string", "Path of a note, relative to the vault")}
# Fixed: the names of tools and parameters. Name: what it does, its parameters, and which of them are required.
TOOLS: dict[str, tuple[str, dict[str, tuple[str, str]], list[str]]] = {
    "list_notes": ("List the notes of a folder.", {"folder": ("string", "Folder; all notes if empty")}, []),
    "read_note": ("Read a whole note.", _PATH, ["path"]),
    "search_vault": ("Find lines by a pattern.", {"query": ("string", "Regular expression or text")}, ["query"]),
    "get_note_links": ("Outgoing links and backlinks.", _PATH, ["path"]),
    "get_note_metadata": ("Frontmatter and inline tags.", _PATH, ["path"]),
    "edit_note": (
        "Plan an edit of a note.",
        _PATH
        | {
            "operation": ("string", "append, prepend or replace"),
            "content": ("string", "The new text"),
            "target": ("string", "The text to replace"),
        },
        ["path", "content"],
    ),
}


def schemas() -> list[dict]:
    """The tools as JSON function schemas."""
    return [
        {
            "type": "function",
            "function": {
                "name": name,
                "description": says,
                "parameters": {
                    "type": "object",
                    "properties": {k: {"type": kind, "description": text} for k, (kind, text) in parameters.items()},
                    "required": required,
                },
            },
        }
        for name, (says, parameters, required) in TOOLS.items()
    ]


class Called:
    """Runs the methods that TOOLS names."""

    def schemas(self) -> list[dict]:
        return schemas()

    def __call__(self, name: str, arguments: dict) -> str:
        """Runs a tool; an unknown name or any error is answered by a text."""
        tool: Callable[..., str] | None = getattr(self, name) if name in TOOLS else None
        if tool is None:
            return f"Error: unknown tool '{name}'"
        try:
            return tool(**arguments)
        except Exception as error:  # noqa: BLE001  the model reads what went wrong
            return f"Error: {error}"


class NoteTools(Called):
    """Answers tool calls from one snapshot of the notes and the edits planned on it, which go to the
    planned list: later calls see them, the notes are not touched."""

    def __init__(self, notes: DataFrame):
        self.before = hashed(notes) if "content_hash" not in notes.columns else notes
        self.planned: list[dict] = []

    @property
    def notes(self) -> DataFrame:
        if not self.planned:
            return self.before
        return with_edits(self.before, self.before.sparkSession.createDataFrame(self.planned, EDITS))

    def _one(self, path: str, *columns: Any):
        if not path:
            raise ValueError("path is required")
        row = self.notes.where(F.col("path") == path).select(*columns).first()
        if row is None:
            raise ValueError(f"note '{path}' not found")
        return row

    def list_notes(self, folder: str = "") -> str:
        rows = [row["path"] for row in list_notes(self.notes, folder).collect()]
        if folder and not rows:
            raise ValueError(f"folder '{folder}' does not exist")
        return "\n".join(rows) or "No notes found."

    def read_note(self, path: str = "") -> str:
        return self._one(path, "content")["content"]

    def search_vault(self, query: str = "") -> str:
        if not query:
            raise ValueError("query is required")
        rows = search(self.notes, query).orderBy(sort_key(F.col("path")), "line_no").collect()
        found = [f"{row['path']}:{row['line_no']}: {row['line']}" for row in rows]
        if any(row["truncated"] for row in rows):
            found.append("... (truncated, too many results)")
        return "\n".join(found) or "No matches found."

    def get_note_links(self, path: str = "") -> str:
        out = self._one(path, outgoing_links(F.col("content")).alias("out"))["out"]
        back = [row["src_path"] for row in backlinks(self.notes).where(F.col("path") == path).orderBy(sort_key(F.col("src_path"))).collect()]
        return f"Outgoing links: {out or 'none'}\nBacklinks: {back or 'none'}"

    def get_note_metadata(self, path: str = "") -> str:
        row = self._one(path, frontmatter(F.col("content")).alias("fields"), inline_tags(F.col("content")).alias("tags"))
        return f"Frontmatter: {row['fields'] or 'none'}\nInline tags: {row['tags'] or 'none'}"

    def edit_note(self, path: str = "", operation: str = "append", content: str = "", target: str = "") -> str:
        old = self._one(path, "content")["content"]
        error = edit_error(path, old, operation, content, target)
        if error:
            raise ValueError(error)
        base = self.before.where(F.col("path") == path).first()["content_hash"]
        seq = len(self.planned)
        self.planned.append({"path": path, "seq": seq, "tie": "", "operation": operation, "content": content, "target": target, "base_hash": base})
        return f"Planned an edit of '{path}' ({operation})"


class SnapshotTools(Called):
    """The same tools over notes that write() left in a shared folder. It holds two paths only, so it
    travels to executors inside a client. Edits are planned: each is a line of JSON in a file of its own in
    the folder edits, below a folder for its note. A note that is read is read with its edits; searches, links
    and metadata are those of the snapshot."""

    def __init__(self, folder: str, edits: str | None = None):
        self.folder, self.edits = folder, edits or f"{folder}-edits"

    @classmethod
    def write(cls, notes: DataFrame, edits: str | None = None) -> SnapshotTools:
        """notes in path order, with all that the tools answer from but patterns."""
        notes = hashed(notes) if "content_hash" not in notes.columns else notes
        back = backlinks(notes).groupBy("path").agg(F.array_sort(F.collect_list("src_path")).alias("back"))
        rows = notes.join(back, "path", "left").select(
            "path",
            "content",
            "content_hash",
            is_hidden(F.col("path")).alias("hidden"),
            (~is_hidden(F.col("path")) & (F.col("valid_utf8") if "valid_utf8" in notes.columns else F.lit(True))).alias("searched"),
            lines(F.col("content")).alias("lines"),
            outgoing_links(F.col("content")).alias("out"),
            "back",
            F.to_json(frontmatter(F.col("content"))).alias("fields"),
            inline_tags(F.col("content")).alias("tags"),
        )
        folder = f"{shared_dir(notes.sparkSession)}/tables/note-tools-{uuid.uuid4().hex[:12]}"
        rows.repartitionByRange(sort_key(F.col("path"))).sortWithinPartitions(sort_key(F.col("path"))).write.parquet(folder)
        return cls(folder, edits)

    def _opened(self, folder: str) -> tuple[Any, str]:
        return pyarrow.fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")

    def _rows(self, columns: list[str], wanted=None) -> Iterator[dict]:
        """In path order: part files are numbered by ranges."""
        fs, path = self._opened(self.folder)
        files = sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(path)) if x.path.endswith(".parquet"))
        for file in files:
            for batch in pyarrow.dataset.dataset(file, filesystem=fs, format="parquet").to_batches(columns=columns, filter=wanted):
                yield from batch.to_pylist()

    def _one(self, path: str, *columns: str) -> dict:
        if not path:
            raise ValueError("path is required")
        row = next(self._rows(list(columns), pyarrow.dataset.field("path") == path), None)
        if row is None:
            raise ValueError(f"note '{path}' not found")
        return row

    def list_notes(self, folder: str = "") -> str:
        start = folder.rstrip("/") + "/" if folder else ""
        rows = [r["path"] for r in self._rows(["path", "hidden"]) if not r["hidden"] and r["path"].startswith(start)]
        if folder and not rows:
            raise ValueError(f"folder '{folder}' does not exist")
        return "\n".join(rows) or "No notes found."

    def _edits_of(self, path: str, base: str) -> list[dict]:
        """The edits planned on this text of a note, in order."""
        fs, root = self._opened(self.edits)
        found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{note_folder(path)}", allow_not_found=True))
        read = (json.loads(fs.open_input_stream(x.path).read()) for x in found if x.path.endswith(".json"))
        return sorted((x for x in read if x["base_hash"] == base), key=lambda x: (x["seq"], x["tie"]))

    def _text(self, path: str) -> tuple[str, str]:
        """A note's text after its edits, and the hash of the text before them."""
        row = self._one(path, "content", "content_hash")
        text = row["content"]
        for x in self._edits_of(path, row["content_hash"]):
            if edit_error(path, text, x["operation"], x["content"], x["target"]) is None:
                text = edit_applied(text, x["operation"], x["content"], x["target"])
        return text, row["content_hash"]

    def read_note(self, path: str = "") -> str:
        return self._text(path)[0]

    def search_vault(self, query: str = "") -> str:
        if not query:
            raise ValueError("query is required")
        try:
            pattern = re.compile(query, re.IGNORECASE)
        except re.error:
            pattern = re.compile(re.escape(query), re.IGNORECASE)
        found: list[str] = []
        for row in self._rows(["path", "searched", "lines"]):
            if row["searched"]:
                found += [f"{row['path']}:{k}: {line.strip()}" for k, line in enumerate(row["lines"] or [], 1) if pattern.search(line)]
            if len(found) > MOST_LINES:
                found.append("... (truncated, too many results)")
                break
        return "\n".join(found) or "No matches found."

    def get_note_links(self, path: str = "") -> str:
        row = self._one(path, "out", "back")
        return f"Outgoing links: {row['out'] or 'none'}\nBacklinks: {row['back'] or 'none'}"

    def get_note_metadata(self, path: str = "") -> str:
        row = self._one(path, "fields", "tags")
        return f"Frontmatter: {json.loads(row['fields'] or '{}') or 'none'}\nInline tags: {row['tags'] or 'none'}"

    def edit_note(self, path: str = "", operation: str = "append", content: str = "", target: str = "") -> str:
        old, base = self._text(path)
        error = edit_error(path, old, operation, content, target)
        if error:
            raise ValueError(error)
        edit = {"path": path, "seq": time.time_ns(), "tie": uuid.uuid4().hex, "operation": operation, "content": content, "target": target, "base_hash": base}
        fs, root = self._opened(self.edits)
        folder = f"{root}/{note_folder(path)}"
        fs.create_dir(folder)
        with fs.open_output_stream(f"{folder}/{edit['seq']}-{edit['tie']}.json") as out:
            out.write(json.dumps(edit).encode())
        return f"Planned an edit of '{path}' ({operation})"


def note_folder(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:32]


def read_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The edits (EDITS) that tools left in a folder; none where there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], EDITS)
    return spark.read.schema(EDITS).option("recursiveFileLookup", "true").json(folder)
