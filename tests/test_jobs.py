"""The jobs, over growing and awkward copies of the tables."""

import hashlib
import json
import os
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from jobs import queries
from jobs.note_feed import FEED, note_feed
from jobs.related_notes import REPORT, related_notes

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ROOT = Path(__file__).resolve().parent.parent


def put(spark, folder, rows, when):
    """A part file of documents that is as old as when says."""
    path = f"{folder}/documents-{when}.parquet"
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(path)
    for file in Path(path).iterdir():
        os.utime(file, (when, when))


def note(k, text, lang="en", source="s"):
    return (k, text, lang, source, None)


def feed(spark, folder):
    rows = spark.read.schema(FEED).parquet(f"{folder}/feed").collect()
    return sorted((r["batch"], r["path"], r["status"], r["content_hash"]) for r in rows)


def short(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def test_feed_takes_only_what_is_new(spark, tmp_path):
    source, run = tmp_path / "in", lambda: note_feed(spark, f"{tmp_path}/in", f"{tmp_path}/feed", f"{tmp_path}/progress")
    source.mkdir()
    put(spark, source, [note(1, "one"), note(2, "two"), note(3, "three", "de"), note(None, "lost")], 1000)
    assert run() == {"batches": 1, "read": 4, "without_id": 1, "written": 3}
    first = feed(spark, tmp_path)
    assert first == [(0, "s/de-3.md", "new", short("three")), (0, "s/en-1.md", "new", short("one")), (0, "s/en-2.md", "new", short("two"))]
    # an edited note, one that is as it was, and a new one
    put(spark, source, [note(1, "one more"), note(2, "two"), note(4, None, None, None)], 2000)
    assert run() == {"batches": 1, "read": 3, "without_id": 0, "written": 2}
    second = feed(spark, tmp_path)
    assert second == first + [(1, "s/en-1.md", "changed", short("one more")), (1, "unsorted/xx-4.md", "new", short(""))]
    # an edit that goes back to an old text is a change; files of one batch count by their age
    put(spark, source, [note(1, "one"), note(2, "late")], 4000)
    put(spark, source, [note(1, "between"), note(2, "early")], 3000)
    assert run()["written"] == 2
    third = feed(spark, tmp_path)
    assert third == second + [(2, "s/en-1.md", "changed", short("one")), (2, "s/en-2.md", "changed", short("late"))]
    assert run() == {"batches": 0, "read": 0, "without_id": 0, "written": 0}
    assert feed(spark, tmp_path) == third


def test_feed_after_a_crash(spark, tmp_path):
    """A batch that was written, but not noted as done, is run again and replaces itself."""
    (tmp_path / "in").mkdir()
    run = lambda: note_feed(spark, f"{tmp_path}/in", f"{tmp_path}/feed", f"{tmp_path}/progress")
    for when in (1000, 2000):
        put(spark, tmp_path / "in", [note(1, f"text of {when}"), note(when, "x", "fr")], when)
        run()
    whole = feed(spark, tmp_path)
    done = tmp_path / "progress" / "commits" / "1"
    assert done.exists()
    done.unlink()
    (tmp_path / "progress" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run()["written"] == 2
    assert feed(spark, tmp_path) == whole


def test_feed_in_many_batches_ends_alike(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for when in (1000, 2000, 3000):
        put(spark, tmp_path / "in", [note(k, f"text {k} of {when if k % 2 else 0}") for k in range(6)], when)
    counts = note_feed(spark, f"{tmp_path}/in", f"{tmp_path}/feed", f"{tmp_path}/progress", {"files_per_batch": 1})
    assert counts["batches"] >= 3
    found = feed(spark, tmp_path)
    assert Counter(status for _, _, status, _ in found) == {"new": 6, "changed": 6}
    last = {path: digest for _, path, _, digest in found}
    assert last == {f"s/en-{k}.md": short(f"text {k} of {3000 if k % 2 else 0}") for k in range(6)}


def test_feed_says_what_notes_hold(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(spark, tmp_path / "in", [note(1, "---\ntitle: x\n---\nremember, remember [[Other|o]] the  gardens\n[[Second]]"), note(2, " \n ")], 1000)
    note_feed(spark, f"{tmp_path}/in", f"{tmp_path}/feed", f"{tmp_path}/progress")
    one, two = spark.read.schema(FEED).parquet(f"{tmp_path}/feed").orderBy("path").collect()
    assert (one["links"], one["fields"], one["n_words"]) == (["Other", "Second"], {"title": "x"}, 10)
    assert one["tags"][0] == "remember" and "gardens" in one["tags"]
    assert (two["tags"], two["links"], two["fields"], two["n_words"]) == ([], [], {}, 0)


def test_feed_of_repeated_rows(spark, tmp_path):
    """Of rows with one path in one file the greatest hash counts, and a row that is there twice counts once."""
    (tmp_path / "in").mkdir()
    put(spark, tmp_path / "in", [note(1, "a"), note(1, "b"), note(1, "a"), note(1, "b"), note(2, "c"), note(2, "c")], 1000)
    assert note_feed(spark, f"{tmp_path}/in", f"{tmp_path}/feed", f"{tmp_path}/progress")["written"] == 2
    assert feed(spark, tmp_path) == [(0, "s/en-1.md", "new", max(short("a"), short("b"))), (0, "s/en-2.md", "new", short("c"))]


def test_feed_holds_no_texts(spark, tmp_path, monkeypatch):
    """What is written and sorted on the way has no texts, and no words are dealt out."""
    from jobs import note_feed as job

    tables, written = [], job.stash
    monkeypatch.setattr(job, "stash", lambda df, name: tables.append(df.columns) or written(df, name))
    (tmp_path / "in").mkdir()
    put(spark, tmp_path / "in", [note(k, f"gardens {k}") for k in range(5)], 1000)
    note_feed(spark, f"{tmp_path}/in", f"{tmp_path}/feed", f"{tmp_path}/progress")
    assert tables == [["path", "modified", "content_hash", "status"]]
    rows = spark.createDataFrame([], "path string, lang string, content string, content_hash string, modified timestamp")
    marks = spark.createDataFrame([], "path string, modified timestamp, content_hash string, status string")
    plan = job.with_texts(marks, rows, 6)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan
    assert not re.search("SortMergeJoin|Generate|Window", plan)


def test_feed_of_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(spark, tmp_path / "in", [], 1000)
    assert note_feed(spark, f"{tmp_path}/in", f"{tmp_path}/feed", f"{tmp_path}/progress")["written"] == 0
    put(spark, tmp_path / "in", [note(1, "first")], 2000)
    assert note_feed(spark, f"{tmp_path}/in", f"{tmp_path}/feed", f"{tmp_path}/progress")["written"] == 1


def report(spark, folder):
    rows = spark.read.schema(REPORT).parquet(f"{folder}/report").collect()
    return sorted((r["lang"], r["path"], r["tags"], r["n_merged"], [tuple(x) for x in r["related"]]) for r in rows)


TOPICS = [
    note(1, "painting painting gardening gardening cooking!"),
    note(2, "paintings gardening woodworking"),
    note(3, "painting gardening [[de-1]] woodworking", "de"),
    note(4, "gardening painting [[en-1]] x", "en", None),
    note(5, None),
    note(6, "nothing here"),
    note(6, "nothing there"),
    note(None, "painting gardening"),
]


def test_report(spark, tmp_path):
    spark.createDataFrame(TOPICS, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    counts = related_notes(spark, f"{tmp_path}", f"{tmp_path}/report")
    first = report(spark, tmp_path)
    assert (counts["read"], counts["without_id"], counts["written"]) == (8, 1, 6)
    found = {path: (tags, merged, related) for _, path, tags, merged, related in first}
    assert found["s/en-2.md"][:2] == (["gardening", "painting", "woodworking"], 1)
    # 4 links to the stem of 1, so these two are no suggestion for each other; 3 links to nobody's stem
    assert found["s/en-1.md"][2] == [("s/de-3.md", 2), ("s/en-2.md", 2)]
    assert found["s/en-2.md"][2] == [("s/de-3.md", 3), ("s/en-1.md", 2), ("unsorted/en-4.md", 2)]
    assert found["s/en-5.md"] == ([], 0, [])
    assert related_notes(spark, f"{tmp_path}", f"{tmp_path}/report") == counts and report(spark, tmp_path) == first
    # fewer notes, and a language gone: nothing old stays
    spark.createDataFrame(TOPICS[:2], COLUMNS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    related_notes(spark, f"{tmp_path}", f"{tmp_path}/report", {"most_related": 1})
    assert [path for _, path, *_ in report(spark, tmp_path)] == ["s/en-1.md", "s/en-2.md"]
    spark.createDataFrame([], COLUMNS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert related_notes(spark, f"{tmp_path}", f"{tmp_path}/report")["written"] == 0


def test_report_deals_out_no_words(spark, tmp_path, monkeypatch):
    """A note's tags are counted in its row, not shuffled by word."""
    from jobs import related_notes as job

    plans, written = {}, job.stash

    def stash(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        if name == "report-states":
            raise InterruptedError
        return written(df, name)

    monkeypatch.setattr(job, "stash", stash)
    spark.createDataFrame(TOPICS, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(InterruptedError):
        job.related_notes(spark, f"{tmp_path}", f"{tmp_path}/report")
    assert not re.search("Generate|Window|Join", plans["report-states"])


def test_report_of_frequent_tags(spark, tmp_path):
    """Tags that are on very many notes relate them like others."""
    rows = [note(k, "painting gardening" + (" [[en-12]]" if k == 10 else "")) for k in range(10, 40)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert related_notes(spark, f"{tmp_path}", f"{tmp_path}/report")["related"] == 30
    found = {path: [int(other[5:-3]) for other, n in related if n == 2] for _, path, _, _, related in report(spark, tmp_path)}
    # 10 links to 12, so that they are no suggestion for each other
    assert found == {f"s/en-{k}.md": [j for j in range(10, 40) if j != k and {j, k} != {10, 12}][:5] for k in range(10, 40)}


def test_settings_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown"):
        related_notes(spark, SF, f"{tmp_path}/report", {"most_relatives": 1})
    for name in ("note_feed", "related_notes"):
        given = json.loads((ROOT / "jobs" / f"{name}.json").read_text())
        assert given == __import__(f"jobs.{name}", fromlist=["DEFAULTS"]).DEFAULTS


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).values.tolist()), key=repr)
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_command_line(tmp_path):
    given = ["--input", SF, "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/progress", "--config", "jobs/note_feed.json", "--master", "local[2]"]
    done = subprocess.run([sys.executable, "-m", "jobs.note_feed", *given], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = json.loads(done.stdout.splitlines()[-1])
    assert counts["read"] == counts["written"] > 0 and re.search(r"batch 0: read \d+ rows .* wrote \d+ notes", done.stderr)
    assert any(p.name.startswith("lang=") for p in (tmp_path / "out" / "batch=0").iterdir())


def test_jobs_stand_alone():
    for file in (ROOT / "jobs").glob("*.py"):
        assert not re.search(r"marginalia\.llm|corpus_pipeline", file.read_text())
