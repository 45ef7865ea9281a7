"""Planned edits: replay in order, conflicts, own edits in reads, and writing them."""

import pickle

import pytest
from pyspark.sql import functions as F
from test_vault import fill

from marginalia.operators import edit_log as D
from marginalia.operators.search import hashed
from marginalia.plans.pipeline import Notebook
from marginalia.plans.store import Store
from marginalia.plans.tools import NoteTools, SnapshotTools, read_edits
from marginalia.sources.vault import read_vault, write_edits


def edit(path, seq, operation, content, target="", base=None, tie=""):
    return (path, seq, tie, operation, content, target, base)


def plain(notes, edits):
    """One edit at a time, from a dictionary of texts."""
    texts, failed = dict(notes), []
    for path, _seq, _, operation, content, target, _ in sorted(edits, key=lambda e: (e[0], e[1], e[2])):
        error = D.edit_error(path, texts.get(path), operation, content, target)
        if error:
            failed.append((path, _seq, error))
        else:
            texts[path] = D.edit_applied(texts[path], operation, content, target)
    return texts, failed


def test_replay_against_one_at_a_time(spark):
    notes = [("a.md", "one $1 two"), ("b.md", ""), ("c.md", "x\\y"), ("d.md", "unread")]
    df = hashed(spark.createDataFrame(notes, "path string, content string"))
    base = {r["path"]: r["content_hash"] for r in df.collect()}
    edits = [
        edit("a.md", 2, "append", "end"),
        edit("a.md", 1, "replace", "$0 \\ first", "one"),
        edit("a.md", 3, "replace", "FIRST", "first"),
        edit("a.md", 4, "replace", "never", "one"),
        edit("a.md", 5, "prepend", "top", tie="b"),
        edit("a.md", 5, "prepend", "higher", tie="a"),
        edit("b.md", 1, "append", "é\n"),
        edit("b.md", 2, "other", "x"),
        edit("b.md", 3, "replace", "x"),
        edit("b.md", 4, "append", ""),
        edit("c.md", 1, "replace", "z", "\\"),
    ]
    edits = [(*e[:6], base[e[0]]) for e in edits]
    table = spark.createDataFrame(edits, D.EDITS).repartition(3)
    texts, failed = plain(notes, edits)
    after = {r["path"]: r["content"] for r in D.with_edits(df, table).collect()}
    assert after == texts and after["a.md"] == "top\nhigher\n$0 \\ FIRST $1 two\nend"
    found = D.replayed(df, table)
    assert sorted((r["path"], r["seq"], r["error"]) for r in D.failures(found).collect()) == sorted(failed)
    assert {r["path"]: r["n_applied"] for r in found.collect()} == {"a.md": 5, "b.md": 1, "c.md": 1}


def test_edits_of_another_text_are_conflicts(spark):
    df = hashed(spark.createDataFrame([("a.md", "now")], "path string, content string"))
    now = df.first()["content_hash"]
    edits = [edit("a.md", 1, "append", "old", base="older"), edit("a.md", 2, "append", "new", base=now), edit("gone.md", 1, "append", "x", base="h"), edit(None, 1, "append", "x"), edit("", 1, "append", "x")]
    found = D.replayed(df, spark.createDataFrame(edits, D.EDITS))
    assert {r["path"]: r["new_content"] for r in found.collect()} == {"a.md": "now\nnew", "gone.md": None}
    assert sorted(map(tuple, D.failures(found).collect())) == [("a.md", 1, "note changed since"), ("gone.md", 1, "note not found")]
    none = spark.createDataFrame([], D.EDITS)
    assert D.replayed(df, none).count() == 0 and D.with_edits(df, none).first()["content"] == "now"


@pytest.mark.parametrize("kind", ["notes", "snapshot"])
def test_reads_see_own_edits(spark, tmp_path, kind):
    notes = read_vault(spark, fill(tmp_path / "v", {"a.md": b"one two", "b.md": b"b"}))
    tools = NoteTools(notes) if kind == "notes" else pickle.loads(pickle.dumps(SnapshotTools.write(notes, str(tmp_path / "edits"))))
    assert tools("edit_note", {"path": "a.md", "operation": "replace", "target": "two", "content": "three"}).startswith("Planned")
    assert tools("read_note", {"path": "a.md"}) == "one three"
    # the second edit stands on the first
    assert tools("edit_note", {"path": "a.md", "operation": "replace", "target": "two", "content": "x"}) == "Error: target not found"
    assert tools("edit_note", {"path": "a.md", "operation": "replace", "target": "three", "content": "four"}).startswith("Planned")
    assert tools("edit_note", {"path": "a.md", "content": "end"}).startswith("Planned")
    assert tools("read_note", {"path": "a.md"}) == "one four\nend" and tools("read_note", {"path": "b.md"}) == "b"
    if kind == "notes":
        assert tools("search_vault", {"query": "four"}) == "a.md:1: one four"


def test_apply_edits(spark, tmp_path, capsys, monkeypatch):
    from marginalia.__main__ import asked

    root, said = fill(tmp_path / "v", {"a.md": b"one two", "b.md": b"b", "c.md": b"c"}), []
    book = Notebook(spark, root, Store(spark, str(tmp_path / "s")), report=said.append)
    assert book.apply_edits() == {"written": 0, "applied": 0, "failed": 0}
    tools = SnapshotTools.write(book.notes(), book.edits_folder)
    for path, operation, content, target in (("a.md", "replace", "three", "two"), ("a.md", "append", "end", ""), ("b.md", "prepend", "top", ""), ("c.md", "append", "lost", "")):
        tools("edit_note", {"path": path, "operation": operation, "content": content, "target": target})
    (tmp_path / "v/c.md").write_text("edited by hand")
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert book.apply_edits(asked)["written"] == 0 and "+one three" in capsys.readouterr().out
    assert read_edits(spark, book.edits_folder).count() == 4  # refused edits stay
    assert book.apply_edits() == {"written": 2, "applied": 3, "failed": 1}
    assert (tmp_path / "v/a.md").read_text() == "one three\nend" and (tmp_path / "v/b.md").read_text() == "top\nb"
    assert (tmp_path / "v/c.md").read_text() == "edited by hand" and said == ["edit not done: c.md: note changed since"]
    assert book.apply_edits() == {"written": 0, "applied": 0, "failed": 0}


def test_writer_checks_the_text_it_replaces(spark, tmp_path):
    root = fill(tmp_path, {"a.md": b"x", "b.md": b"y\r\n", "c.md": b"done"})
    notes = {r["path"]: r["content_hash"] for r in read_vault(spark, root).collect()}
    plan = [("a.md", "new", "other hash"), ("b.md", "new", notes["b.md"]), ("c.md", "done", "other hash")]
    done = write_edits(spark.createDataFrame(plan, "path string, new_content string, base_hash string"), root)
    # c is what an earlier try of the task left
    assert {tuple(r) for r in done.collect()} == {("a.md", False), ("b.md", True), ("c.md", True)}
    assert (tmp_path / "a.md").read_bytes() == b"x" and (tmp_path / "b.md").read_bytes() == b"new"
