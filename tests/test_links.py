"""Validation, repair and cleaning of proposed links; edges and backlinks."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import edit_join as E
from marginalia.operators import links as L
from marginalia.operators import state as S


def states(spark, links, path="n.md", applied=True):
    return spark.createDataFrame([(path, 0, "h", 0.0, [], links, False, applied)], S.STATE)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("Dir/Note.md",), ("Other.md",)], "path string")


@pytest.mark.parametrize(
    ("target", "plain", "fixed"),
    [
        ("Dir/Note.md", ("valid", None), ("valid", None)),
        ("Note", ("valid", None), ("fixed", "Dir/Note.md")),
        ("Note.md", ("valid", None), ("fixed", "Dir/Note.md")),
        ("Wrong/note.md", ("fixable", "Dir/Note.md"), ("fixed", "Dir/Note.md")),
        ("Othr", ("fixable", "Other.md"), ("fixed", "Other.md")),
        ("Completely different", ("invalid", None), ("removed", None)),
    ],
)
def test_validation(spark, files, target, plain, fixed):
    rows = states(spark, [(target, "r")])
    for fix, want in ((False, plain), (True, fixed)):
        row = L.validated(rows, files, fix).first()
        assert (row["status"], row["correction"]) == want


def test_counts(spark, files):
    rows = states(spark, [("Other.md", ""), ("Note", ""), ("Othr", ""), ("Completely different", "")])
    assert tuple(L.validation_counts(L.validated(rows, files)).first()) == (2, 2, 0, 0)
    assert tuple(L.validation_counts(L.validated(rows, files, True)).first()) == (2, 1, 2, 1)


def test_fix_resets_flag_of_an_emptied_list(spark, files):
    row = L.fixed_links(states(spark, [("Completely different", "")]), files).first()
    assert row["proposed_links"] == [] and row["links_applied"] is False
    assert L.fixed_links(states(spark, []), files).first()["links_applied"] is True


def test_dedup_keeps_longest_reason_at_first_place(spark):
    rows = states(spark, [("t", ""), ("u", "aa"), ("t", "long"), ("t", "ll"), ("u", "bb"), ("v", None)])
    after = L.deduplicated(rows)
    assert [tuple(x) for x in after.first()["proposed_links"]] == [("t", "long"), ("u", "aa"), ("v", None)]
    assert L.removed_links(rows, after).first()["removed"] == 3
    assert L.deduplicated(after).first() == after.first()


def test_self_links(spark):
    rows = states(spark, [("n.md", ""), ("N.md", ""), (None, "")])
    assert [x["target"] for x in L.without_self_links(rows).first()["proposed_links"]] == ["N.md", None]


def test_backlinks(spark):
    notes = spark.createDataFrame(
        [("A.md", "[[A]]"), ("b.md", "see [[A|x]]"), ("c.md", "[[Folder/A]]"), (".h.md", "[[A]]"), ("d/e.md", "[[[A]]"), ("x[1].md", ""), ("f.md", "[[x[1]]]")],
        "path string, content string",
    )
    got = {tuple(r) for r in L.backlinks(notes).select("path", "src_path").collect()}
    assert got == {("A.md", "b.md"), ("A.md", "d/e.md"), ("x[1].md", "f.md")}


def test_backlinks_to_odd_stems(spark):
    """Stems with brackets and bars, against a search of every text for every stem."""
    names = ["a", "a]b", "a|b", "[a", "a]", "x[1]", "|", "]]", "a]]b", "[[a]]", "ab"]
    texts = ["[[a]]", "[[a]b]]", "[[a|b]]", "[[[a]]", "[[a]]]", "[[x[1]]]", "[[||", "[[]]]]", "[[a]]b|", "[[[[a]]]]", "[[a|b|c]] [[ab", "[[\na]]", "[[", "[", "x"]
    notes = [(f"{n}.md", t) for n, t in zip(names, texts)] + [(f"t{k}.md", t) for k, t in enumerate(texts[len(names) :])]
    want = {(a, b) for a, _ in notes for b, t in notes if a != b and (f"[[{a[:-3]}]]" in t or f"[[{a[:-3]}|" in t)}
    found = L.backlinks(spark.createDataFrame(notes, "path string, content string"))
    assert {tuple(r) for r in found.collect()} == want and len(want) >= 9
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_verdicts(spark):
    rows = states(spark, [("old.md", "")], applied=True)
    verdicts = [("n.md", "old.md", None, None, "r", 1), ("n.md", "p.md", None, None, "r", 2), ("n.md", "p.md", None, None, "s", 3), ("n.md", "q.md", "new.md", "z.md", None, 4)]
    verdicts = spark.createDataFrame(verdicts, "note_a string, note_b string, link_from string, link_to string, reason string, seq long")
    after = {r["path"]: r for r in L.with_verdicts(rows, verdicts).collect()}
    assert [tuple(x) for x in after["n.md"]["proposed_links"]] == [("old.md", ""), ("p.md", "r")]
    assert after["n.md"]["links_applied"] is False
    assert after["new.md"]["content_hash"] is None and [tuple(x) for x in after["new.md"]["proposed_links"]] == [("z.md", "")]


def test_targets_near_a_name_do_not_meet_by_three_edits(spark, monkeypatch):
    """Of 300 like names, each target meets the one it is nearest to; one target has none so near."""
    names = [f"en-{k}" for k in range(1000, 1300)]
    wanted = [f"{n}zz" for n in names[::10]] + ["en-1200xyz", "entirely different"]
    calls, join = [], E.edit_join
    monkeypatch.setattr(E, "edit_join", lambda left, a, right, b, n: (calls.append((n, left.count(), right.count())), join(left, a, right, b, n))[1])
    table = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    found = E.nearest_join(table(wanted, "want"), "want", table(names, "stem"), "stem", 3)
    best = {r["want"]: (r["edits"], r["stem"]) for r in found.orderBy("want", "edits", "stem").dropDuplicates(["want"]).collect()}
    assert best == {f"{n}zz": (2, n) for n in names[::10]} | {"en-1200xyz": (3, "en-1200")}
    assert calls == [(2, 32, 300), (3, 2, 300)]


def test_keys_of_targets_are_not_sent_through_the_driver(spark):
    """Both sides are small by the planner's sizes; their keys, many for each string, are dealt out."""
    a, b = (spark.range(n).select(F.concat(F.lit("name-"), "id").alias(c)) for n, c in ((9, "want"), (30, "stem")))
    found = E.edit_join(a, "want", b, "stem", 2)
    assert found.count() == 270
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key#" in plan and "BroadcastHashJoin [key#" not in plan


def test_linked_pairs(spark):
    """Both ways, of all notes with the stem, as already_linked finds them among all pairs."""
    rows = [("s/a.md", "[[b]] [[b|x]] [[a]]"), ("t/b.md", ""), ("u/b.md", "[[c#h]]"), ("c.md", "[[a]] [[none]] [[s/a]]"), ("d.md", None)]
    notes = spark.createDataFrame(rows, "path string, content string")
    both = {("s/a.md", "t/b.md"), ("s/a.md", "u/b.md"), ("c.md", "s/a.md")}
    got = [tuple(r) for r in L.linked_pairs(notes).collect()]
    assert len(got) == 6 and {tuple(sorted(r)) for r in got} == both and set(got) == {(b, a) for a, b in got}
    pairs = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "note_a string, note_b string")
    assert {tuple(r) for r in L.already_linked(pairs, L.edges(notes)).select("note_a", "note_b").collect()} == both
