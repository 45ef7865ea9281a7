"""The state log: what is written, what is read, and what a crash leaves."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marginalia.operators import state as S
from marginalia.plans import store as P
from marginalia.plans.pipeline import Notebook
from marginalia.plans.store import Snapshot, Store


def records(spark, rows):
    """Records (path, ord, hash), all else alike."""
    df = spark.createDataFrame(rows, "path string, ord long, content_hash string")
    empty = F.array().cast(f"array<{S.LINK}>")
    return df.select(
        "path", "ord", "content_hash", F.lit(1.0).alias("processed_at"), F.array(F.lit("t")).alias("proposed_tags"),
        empty.alias("proposed_links"), F.lit(False).alias("tags_applied"), F.lit(False).alias("links_applied"),
    )


def pairs(spark, rows):
    return spark.createDataFrame(rows, S.PAIRS)


def held(store):
    now = store.load()
    return {r["path"]: (r["ord"], r["content_hash"]) for r in now.states.collect()}, sorted(map(tuple, now.evaluated.collect()))


def rows_on_disk(spark, store, kind):
    return {p.parent.name: spark.read.parquet(str(p)).count() for p in Path(store.folder).glob(f"v-*/{kind}")}


def test_a_commit_writes_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(records(spark, [(f"{k}.md", k, "old") for k in range(500)]), last_run=1.0)
    for k in range(3):
        store.append(records(spark, [(f"{k}.md", k, f"new{k}"), (f"more{k}.md", 500 + k, "x")]), pairs(spark, [("a", f"{k}")]))
    store.append(last_completed_run=2.0)
    assert sorted(rows_on_disk(spark, store, "state").values()) == [2, 2, 2, 500]
    assert sorted(rows_on_disk(spark, store, "pairs").values()) == [0, 1, 1, 1]
    states, evaluated = held(store)
    assert len(states) == 503 and states["2.md"] == (2, "new2") and states["9.md"] == (9, "old") and evaluated == [("a", str(k)) for k in range(3)]
    now = store.load()
    assert (now.last_run, now.last_completed_run) == (1.0, 2.0)


def test_a_crash_before_the_commit_is_named(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.append(records(spark, [("a.md", 0, "h0")]), pairs(spark, [("a", "b")]))
    whole = held(store)

    class Crash(Exception):
        pass

    def fail(text, *_, **__):
        raise Crash

    monkeypatch.setattr(P.json, "dumps", fail)
    with pytest.raises(Crash):
        store.append(records(spark, [("a.md", 0, "h1"), ("b.md", 1, "h1")]), pairs(spark, [("a", "c")]))
    with pytest.raises(Crash):
        store.compact()
    monkeypatch.undo()
    assert held(store) == whole and held(Store(spark, str(tmp_path / "s"))) == whole
    store.append(records(spark, [("b.md", 1, "h2")]))
    assert held(store)[0] == {"a.md": (0, "h0"), "b.md": (1, "h2")}


@pytest.mark.parametrize("seed", [1, 2])
def test_log_against_a_dictionary(spark, tmp_path, monkeypatch, seed):
    """Deltas, merges, whole versions and clearings in a drawn order."""
    monkeypatch.setattr(P, "MOST_DELTAS", 3)
    monkeypatch.setattr(P, "KEPT", 2)
    draw, store, states, evaluated = random.Random(seed), Store(spark, str(tmp_path / "s")), {}, set()
    for step in range(12):
        some = {f"{draw.randrange(12)}.md": (step, f"h{step}") for _ in range(draw.randrange(4))}
        more = {(f"{draw.randrange(5)}", "x") for _ in range(draw.randrange(3))}
        clears = draw.random() < 0.2
        rows = records(spark, [(k, *v) for k, v in some.items()]) if some else None
        store.append(rows, pairs(spark, sorted(more)) if more else None, clear_pairs=clears)
        states |= some
        evaluated = (set() if clears else evaluated) | more
        assert held(store) == (states, sorted(evaluated)), step
    assert len(list(Path(store.folder, "commits").glob("v-*.json"))) <= 2 + 1 + 3 + 1


def test_versions_of_before_are_read(spark, tmp_path):
    """A store of whole versions only, which is what it held once, goes on with deltas."""
    store = Store(spark, str(tmp_path / "s"))
    store.commit(Snapshot(records(spark, [("a.md", 0, "h")]), pairs(spark, [("a", "b")]), 1.0))
    assert all("delta" not in p.name for p in Path(store.folder, "commits").iterdir())
    store.append(records(spark, [("c.md", 1, "h")]))
    assert held(store) == ({"a.md": (0, "h"), "c.md": (1, "h")}, [("a", "b")])


def test_small_batches_write_little(spark, tmp_path):
    """Twelve notes in batches of two: each record is written once."""
    root = tmp_path / "v"
    root.mkdir()
    for k in range(12):
        (root / f"{k}.md").write_text(f"planning quarterly document number{k}")
    book = Notebook(spark, str(root), Store(spark, str(tmp_path / "s")), report=lambda _: None, batch_notes=2)
    assert book.run()["processed"] == 12
    assert sum(rows_on_disk(spark, book.store, "state").values()) == 12
    assert sorted(r["ord"] for r in book.store.load().states.collect()) == list(range(12))
    (root / "3.md").write_text("other words entirely")
    assert book.run()["processed"] == 1
    assert sum(rows_on_disk(spark, book.store, "state").values()) == 13
    assert book.apply_tags() == 12 and sum(rows_on_disk(spark, book.store, "state").values()) == 25


def test_changed_records(spark):
    before = records(spark, [("a.md", 0, "h"), ("b.md", 1, None)])
    after = records(spark, [("a.md", 0, "h"), ("b.md", 1, "h"), ("c.md", 2, None)])
    assert sorted(r["path"] for r in S.changed_records(before, after).collect()) == ["b.md", "c.md"]
    assert S.changed_records(after, after).count() == 0


def test_state_file_by_lines(spark, tmp_path):
    """Odd paths and texts, in many parts and in one file, against the reader of whole documents."""
    paths = ["a.md", 'quo"te.md', "back\\slash.md", "new\nline.md", "é/漢 🙂.md", '":{.md', "b|c.md", ",.md", "z" * 5000 + ".md"]
    states = records(spark, [(p, 10 * k, None if k % 2 else f"h{k}") for k, p in enumerate(paths)]).repartition(4)
    states = states.withColumn("proposed_tags", F.array(F.lit('"},{"'), F.lit("]"))).withColumn(
        "proposed_links", F.array(F.struct(F.lit('t"').alias("target"), F.lit("r\n],").alias("reason")))
    )
    evaluated = pairs(spark, [(p, f"{p}x") for p in sorted(paths)])
    S.write_json(S.json_lines(states, evaluated, 1.5), f"{tmp_path}/parts")
    whole = "".join(p.read_text() for p in sorted(Path(tmp_path, "parts").glob("part-*")))
    assert list(json.loads(whole)["notes"]) == paths and json.loads(whole) == json.loads(S.to_json(states, evaluated, 1.5))
    Path(tmp_path, "state.json").write_text(whole)
    Path(tmp_path, "indented.json").write_text(json.dumps(json.loads(whole), indent=2, ensure_ascii=False))
    found = []
    for name in ("parts", "state.json", "indented.json"):
        states_, pairs_, runs = S.read_json(spark, f"{tmp_path}/{name}")
        found.append((states_.orderBy("ord").select("path", "ord", "content_hash", "proposed_tags", "proposed_links").collect(), sorted(map(tuple, pairs_.collect())), runs.collect()))
    assert found[0] == found[1] == found[2] and len(found[0][0]) == len(paths) and found[0][2][0]["last_run"] == 1.5
    S.write_json(S.json_lines(states.limit(0), evaluated.limit(0)), f"{tmp_path}/none")
    assert [df.count() for df in S.read_json(spark, f"{tmp_path}/none")] == [0, 0, 1]
