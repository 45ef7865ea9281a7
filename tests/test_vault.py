"""The vault source, search, state, commands and streaming on real files."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from marginalia import catalog
from marginalia.operators import enrich as E
from marginalia.operators import search as Q
from marginalia.operators import state as S
from marginalia.plans.pipeline import Notebook
from marginalia.plans.store import Store
from marginalia.plans.tools import NoteTools, SnapshotTools, read_edits, schemas
from marginalia.sources import vault
from marginalia.sources.model import ChatClient, calls_of, content_of, joined
from marginalia.sources.vault import inside, listed, read_vault, write_edits
from marginalia.streaming.incremental import follow

FILES = {
    "a/b.md": b"b",
    "a-b.md": b"ab",
    "_idx.md": b"i",
    ".hid/n.md": b"n",
    "empty.md": b"",
    ".h.md": b"h",
    "U.MD": b"u",
    "bad.md": b"\xff\xfe",
    "crlf.md": b"x\r\ny\rz",
}


def fill(root, files):
    for path, raw in files.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_bytes(raw)
    return str(root)


def test_scan(spark, tmp_path):
    notes = read_vault(spark, fill(tmp_path, FILES))
    listed = [r["path"] for r in Q.list_notes(notes).collect()]
    assert listed == [".hid/n.md", "_idx.md", "a/b.md", "a-b.md", "bad.md", "crlf.md", "empty.md"]
    new = S.changed(notes, S.empty_state(spark))
    assert "bad.md" not in {r["path"] for r in new.collect()}
    assert "bad.md" in {r["path"] for r in S.changed(notes, S.empty_state(spark), force=True).collect()}
    assert notes.where("path = 'crlf.md'").first()["content"] == "x\ny\nz"
    with pytest.raises(ValueError):
        inside(tmp_path, "../out.md")


def test_listing_names_files_alone(tmp_path):
    root = fill(tmp_path / "v", FILES | {"folder.md/in.md": b"x", "no.md.txt": b"x"})
    os.symlink(tmp_path / "v" / "a", tmp_path / "v" / "to-a")
    assert sorted(listed(root)) == sorted([".hid/n.md", "_idx.md", "a/b.md", "a-b.md", "bad.md", "crlf.md", "empty.md", "folder.md/in.md"])


def test_large_vaults_are_read_by_larger_tasks(monkeypatch):
    """A task costs as much as reading hundreds of files; every file is in one task."""
    for n, tasks in ((0, 1), (300, 2), (100_000, 128), (600_000, 147)):
        monkeypatch.setattr(vault, "listed", lambda root: (f"{k}.md" for k in range(n)))  # noqa: B023
        parts = vault.VaultReader("", 0).partitions()
        assert len(parts) == tasks and sorted(x for p in parts for x in p.paths) == sorted(f"{k}.md" for k in range(n))
    assert {len(p.paths) for p in vault.VaultReader("", 1000).partitions()} == {1000}


def test_batches_of_a_read_hold_every_note(spark, tmp_path):
    files = {f"{k}.md": b"x" * (k * 1_500_000) for k in range(6)}
    got = read_vault(spark, fill(tmp_path, files)).selectExpr("path", "length(content) AS n").collect()
    assert {r["path"]: r["n"] for r in got} == {path: len(raw) for path, raw in files.items()}


def test_notes_of_a_roundtrip_are_deleted_in_tasks(spark, monkeypatch):
    """The driver finds folders without notes, and deletes these."""
    left, whole = [], shutil.rmtree

    def rmtree(root, **how):
        left.extend([root, *(name for _, _, names in os.walk(root) for name in names)])
        whole(root, **how)

    monkeypatch.setattr(shutil, "rmtree", rmtree)
    notes = [(f"s{k % 3}/{k}.md", "text") for k in range(40)]
    assert catalog.vault_roundtrip(spark, spark.createDataFrame(notes, "path string, content string")).count() == 40
    assert len(left) == 1 and "/vault-" in left[0] and not os.path.exists(left[0])


def test_search_stops_after_the_note_that_exceeds(spark):
    def found(*sizes):
        rows = [(f"{k}.md", "hit\n" * n, True) for k, n in enumerate(sizes)]
        out = Q.search(spark.createDataFrame(rows, "path string, content string, valid_utf8 boolean"), "HIT").collect()
        return len(out), any(r["truncated"] for r in out)

    assert found(60, 50, 5) == (110, True)
    assert found(60, 40) == (100, False)
    assert found(101) == (101, True)
    assert found(0) == (0, False)


def test_invalid_pattern_is_plain_text(spark):
    notes = spark.createDataFrame([("a.md", "x (Y\nno")], "path string, content string")
    assert [r["line"] for r in Q.search_lines(notes, "(y").collect()] == ["x (Y"]


def test_state_json(spark, tmp_path):
    record = {"content_hash": "h", "processed_at": 1.5, "proposed_tags": ["é"], "proposed_links": [{"target": "t", "reason": "r"}], "tags_applied": True, "links_applied": False}
    text = json.dumps({"version": 1, "notes": {"z.md": record, "a.md": {"proposed_tags": []}}, "evaluated_pairs": ["a|b"], "last_run": 2.0, "last_completed_run": None})
    (tmp_path / "s.json").write_text(text)
    states, pairs, runs = S.read_json(spark, str(tmp_path / "s.json"))
    assert [(r["path"], r["ord"]) for r in states.orderBy("ord").collect()] == [("z.md", 0), ("a.md", 1)]
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")] and runs.first()["last_run"] == 2.0
    again = json.loads(S.to_json(states, pairs, 2.0))
    assert again["notes"]["z.md"] == record and again["evaluated_pairs"] == ["a|b"] and list(again["notes"]) == ["z.md", "a.md"]


def test_replies(spark):
    replies = ['```json\n{"tags": ["a"], "links": [{"target": "t"}]}\n```', "{}", "not JSON", "[1]", '{"tags": []}', None]
    rows = spark.createDataFrame(list(enumerate(replies)), "k int, reply string")
    got = {r["k"]: (r["ok"], r["proposed_tags"]) for r in E.parsed_replies(rows).collect()}
    assert got == {0: (True, ["a"]), 1: (False, []), 2: (False, []), 3: (False, []), 4: (True, []), 5: (False, [])}
    verdicts = {'{"should_link": "false"}': True, '{"should_link": false}': False, '{"should_link": true, "reason": "r"}': True, "x": False, "{}": False, None: False}
    verdicts |= {'{"should_link": 0.0}': False, '{"should_link": -2}': True, '{"should_link": []}': False, '{"should_link": [0]}': True, '{"should_link": {}}': False}
    verdicts |= {'{"should_link": null}': False, '{"should_link": ""}': False, '{"x": {"should_link": "yes"}, "should_link": false}': False}
    rows = spark.createDataFrame([(x,) for x in verdicts], "reply string")
    assert {r["reply"]: r["confirmed"] for r in E.parsed_verdicts(rows).collect()} == verdicts


def test_commands(spark, tmp_path):
    shared = "quarterly planning document quarterly planning "
    root = fill(tmp_path / "v", {"one.md": (shared + "alpha").encode(), "d/two.md": (shared + "beta").encode(), "three.md": b"nothing here"})
    book = Notebook(spark, root, Store(spark, str(tmp_path / "s")), report=lambda _: None, batch_notes=2)
    assert book.run() == {"processed": 3, "skipped": 0, "errors": 0}
    assert book.run() == {"processed": 0, "skipped": 0, "errors": 0}
    (tmp_path / "v/three.md").write_text("changed entirely")
    assert book.run()["processed"] == 1
    assert book.discover(force=True) == {"candidates": 1, "confirmed": 1, "skipped": 0}
    assert book.discover()["confirmed"] == 0
    assert tuple(book.validate(fix=True).first())[0] == 1
    assert book.clean() == {"duplicates": 0, "self_links": 0}
    assert book.apply_tags(confirm=lambda plan: False) == 0
    assert book.apply_tags() == 3 and book.apply_links() == 1
    text = (tmp_path / "v/d/two.md").read_text()
    assert text.startswith("---\ntags: [document, planning, quarterly]\n---\n")
    assert text.endswith("## Related Notes\n- [[one]] — shared tags: planning, quarterly, document")
    status = book.status()
    assert status["total"] == 3 and status["pending_tags"] == 0 and status["to_process"] == 3 and status["first"][0] == "d/two.md"
    assert set(book.daily()) == {"run", "normalized", "validated", "cleaned", "discovered", "tags", "links", "status"}


def test_a_lost_answer_loses_nothing_else(spark, tmp_path):
    class Shaky:
        """Fails on one note, and on pairs with one note."""

        def enrich(self, path, content):
            if "two" in path:
                raise OSError("no answer")
            return json.dumps({"tags": ["planning", "quarterly"], "links": []})

        def verify(self, pair):
            if "three" in pair["note_a"] + pair["note_b"]:
                raise OSError("no answer")
            return json.dumps({"should_link": True, "link_from": pair["note_a"], "link_to": pair["note_b"]})

    root = fill(tmp_path / "v", {f"{x}.md": b"text" for x in ("one", "two", "three", "four")})
    said = []
    book = Notebook(spark, root, Store(spark, str(tmp_path / "s")), Shaky(), Shaky(), batch_notes=2, batch_pairs=1, report=said.append)
    assert book.run() == {"processed": 3, "skipped": 0, "errors": 1}
    assert not any("3 of 4" in x for x in said) and any("2 of 4 notes" in x for x in said) and "s left" in said[-1]
    assert "no answer (1): OSError: no answer" in said
    assert book.run()["errors"] == 1  # only the lost one is asked about again
    assert book.discover() == {"candidates": 3, "confirmed": 1, "skipped": 2}
    book.verifier = E.SharedTags()
    assert book.discover()["confirmed"] == 2  # the two pairs whose answers were lost


def test_state_file_commands(spark, tmp_path):
    root = fill(tmp_path / "v", {"one.md": b"planning planning quarterly", "two.md": b"planning quarterly"})
    book = Notebook(spark, root, Store(spark, str(tmp_path / "s")), report=lambda _: None)
    book.run()
    book.discover()
    book.export_json(str(tmp_path / "state.json"))
    other = Notebook(spark, root, Store(spark, str(tmp_path / "t")), report=lambda _: None)
    assert other.import_json(str(tmp_path / "state.json")) == {"notes": 2, "pairs": 1}
    assert other.run()["processed"] == 0 and other.discover()["candidates"] == 1
    other.export_json(str(tmp_path / "again.json"))
    again, first = (json.loads((tmp_path / name).read_text()) for name in ("again.json", "state.json"))
    assert again["notes"] == first["notes"] and again["evaluated_pairs"] == first["evaluated_pairs"] == ["one.md|two.md"]


def test_details_and_previews(spark, tmp_path, capsys, monkeypatch):
    from marginalia.__main__ import asked, listed

    root = fill(tmp_path / "v", {"one.md": b"planning planning quarterly", "two.md": b"planning quarterly"})
    said = []
    book = Notebook(spark, root, Store(spark, str(tmp_path / "s")), report=said.append)
    book.run()
    book.discover(max_frequency=1)
    assert any("planning" in x and "left out" in x for x in said)
    now = book.store.load()
    now.states = now.states.withColumn("proposed_links", F.expr("array(named_struct('target', 'Two.md', 'reason', ''), named_struct('target', 'nowhere at all', 'reason', ''))"))
    book.store.commit(now)
    book.validate(False, listed)
    assert "one.md  Two.md  fixable  two.md" in capsys.readouterr().out
    book.normalize()
    assert "different tags" in said[-1]
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert book.apply_tags(asked) == 0 and "+tags: [planning, quarterly]" in capsys.readouterr().out


def test_writer_skips_lost_notes(spark, tmp_path):
    root = fill(tmp_path, {"a.md": b"x"})
    plan = spark.createDataFrame([("a.md", "é\n"), ("gone.md", "y")], "path string, new_content string")
    assert {tuple(r) for r in write_edits(plan, root).collect()} == {("a.md", True), ("gone.md", False)}
    assert (tmp_path / "a.md").read_bytes() == "é\n".encode() and not (tmp_path / "gone.md").exists()


def test_tools(spark, tmp_path):
    tools = NoteTools(read_vault(spark, fill(tmp_path, {"a.md": b"see [[b]] #t", "d/b.md": b"---\nk: v\n---\nHit"})))
    assert tools("list_notes", {}) == "a.md\nd/b.md" and tools("list_notes", {"folder": "d"}) == "d/b.md"
    assert tools("read_note", {"path": "a.md"}) == "see [[b]] #t"
    assert tools("search_vault", {"query": "hit"}) == "d/b.md:4: Hit"
    assert tools("get_note_links", {"path": "d/b.md"}) == "Outgoing links: none\nBacklinks: ['a.md']"
    assert tools("get_note_metadata", {"path": "d/b.md"}) == "Frontmatter: {'k': 'v'}\nInline tags: none"
    assert tools("edit_note", {"path": "a.md", "content": "x"}).startswith("Planned") and len(tools.planned) == 1
    for name, arguments in (("no_tool", {}), ("read_note", {}), ("read_note", {"path": "x"}), ("search_vault", {}), ("read_note", {"wrong": 1})):
        assert tools(name, arguments).startswith("Error")
    assert all(hasattr(NoteTools, s["function"]["name"]) for s in schemas())


def test_snapshot_tools_answer_alike(spark, tmp_path):
    """Over a written snapshot as over the notes; they travel inside a client and plan edits as files."""
    import pickle

    files = {"a.md": b"see [[b]] #t", "d/b.md": b"---\nk: v\n---\nHit (x", "a-b.md": b"hit", ".hid/n.md": b"hit", "bad.md": b"\xff hit"}
    notes = read_vault(spark, fill(tmp_path, files))
    here, there = NoteTools(notes), pickle.loads(pickle.dumps(ChatClient(tools=SnapshotTools.write(notes)))).tools
    calls = [("list_notes", {}), ("list_notes", {"folder": "d"}), ("list_notes", {"folder": "x"}), ("read_note", {"path": "a.md"}), ("search_vault", {"query": "hit"})]
    calls += [("search_vault", {"query": "(x"}), ("search_vault", {"query": "zz"}), ("get_note_links", {"path": "d/b.md"}), ("get_note_links", {"path": "a.md"})]
    calls += [("get_note_metadata", {"path": p}) for p in ("a.md", "d/b.md", "no.md")] + [("read_note", {}), ("edit_note", {"path": "no.md", "content": "x"})]
    calls += [("edit_note", {"path": "a.md", "operation": "replace", "target": "none", "content": "x"}), ("edit_note", {"path": "a.md", "content": "x"}), ("no_tool", {})]
    calls += [("edit_note", {"path": "a.md", "operation": o, "content": c}) for o, c in (("append", ""), ("replace", "x"), ("other", "x"))]
    for name, arguments in calls:
        assert there(name, arguments) == here(name, arguments), (name, arguments)
    assert [r["path"] for r in read_edits(spark, there.edits).collect()] == ["a.md"] and there.schemas() == schemas()


def test_chat_stream():
    chunks = [{"message": {"content": "a", "thinking": "t"}}, {"message": {"content": "b", "tool_calls": [{"function": {"name": "f"}}]}, "done": True}, {"message": {"content": "late"}}]
    reply = joined(iter([json.dumps(c).encode() for c in chunks] + [b""]))
    assert content_of(reply) == "ab" and calls_of(reply) == [{"function": {"name": "f"}}]


def test_tool_loop_is_bounded():
    client = ChatClient(tools=lambda name, arguments: "again")
    client.chat = lambda messages, tools: {"message": {"content": "", "tool_calls": [{"function": {"name": "f", "arguments": {}}}]}}
    assert client.loop([]).startswith("Error")


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "state"))
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    for round_, rows in enumerate(([("a.md", "documents documents"), ("b.md", "planning")], [("a.md", "documents documents"), ("b.md", "different words")])):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(source)
        follow(spark, source, store, marks).awaitTermination(120)
        states = {r["path"]: r for r in store.load().states.collect()}
        assert len(states) == 2
        assert states["b.md"]["proposed_tags"] == (["planning"] if round_ == 0 else ["different"])
    assert states["a.md"]["proposed_tags"] == ["documents"]


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(f"{k % 7}/{k}",) for k in range(50)], "path string").repartition(5)
    got = S.numbered(rows, S.sort_key(F.col("path"))).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(50))
    assert [r["path"] for r in got] == sorted((r["path"] for r in got), key=lambda p: p.split("/"))
    assert S.numbered(rows.limit(0), F.col("path")).count() == 0


def test_hash(spark):
    row = spark.createDataFrame([("é",)], "content string").select(Q.content_hash(F.col("content")).alias("h")).first()
    assert row["h"] == "4a99557e4033c3539de2eb65472017cad5f9557f7a0625a09f1c3f6e2ba69c4c"[:16]
