"""Planned edits of notes."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import rewrite as R


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("x", "---\ntags: [a, b]\n---\nx"),
        ('---\ntags: ["c", a]\n---\nx', "---\ntags: [a, b, c]\n---\nx"),
        ("---\nk: v\n---\nx", "---\nk: v\ntags: [a, b]\n---\nx"),
        ("---\ntags:\n  - c\n---\nx", "---\ntags:\n  - c\ntags:\n  - a\n  - b\n---\nx"),
        ("---\nx", "---\ntags: [a, b]\n---\n---\nx"),
        ("---\nhashtags: none\n---", "---\nhashtags: none\ntags:\n  - a\n  - b\n---"),
        ("---\ntags: []\nx: tags: [q]\n---", "---\ntags: [a, b]\nx: tags: [a, b]\n---"),
    ],
)
def test_tags(spark, before, after):
    rows = spark.createDataFrame([(before, ["b", "a"])], "c string, t array<string>")
    assert rows.select(R.tagged(F.col("c"), F.col("t"))).first()[0] == after


def test_tags_with_signs_of_replacements(spark):
    rows = spark.createDataFrame([("---\ntags: [a]\n---", ["x\\1", "$0"])], "c string, t array<string>")
    assert rows.select(R.tagged(F.col("c"), F.col("t"))).first()[0] == "---\ntags: [$0, a, x\\1]\n---"


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("x\n", "x\n\n## Related Notes\n- [[Dir/N]] — r\n- [[M]]"),
        ("## Related Notes\n- [[O]]\n\nend\n", "## Related Notes\n- [[O]]\n\nend\n- [[Dir/N]] — r\n- [[M]]"),
        ("", "\n\n## Related Notes\n- [[Dir/N]] — r\n- [[M]]"),
    ],
)
def test_links(spark, before, after):
    rows = spark.createDataFrame([(before, [("Dir/N.md", "r"), ("M.md", "")])], "c string, l array<struct<target:string,reason:string>>")
    assert rows.select(R.linked(F.col("c"), F.col("l"))).first()[0] == after


@pytest.mark.parametrize(
    ("edit", "content", "error"),
    [
        (("p.md", "append", "n", None), "a b a\nn", None),
        (("p.md", "prepend", "n", None), "n\na b a", None),
        (("p.md", "replace", "$1\\", "a"), "$1\\ b a", None),
        (("p.md", "replace", "n", "zz"), None, "target not found"),
        (("p.md", "replace", "n", ""), None, "target is required"),
        (("p.md", "other", "n", ""), None, "unknown operation"),
        (("q.md", "append", "n", ""), None, "note not found"),
        (("p.md", "append", "", ""), None, "content is required"),
        (("", "append", "n", ""), None, "path is required"),
    ],
)
def test_edit(spark, edit, content, error):
    notes = spark.createDataFrame([("p.md", "a b a")], "path string, content string")
    edits = spark.createDataFrame([edit], "path string, operation string, content string, target string")
    row = R.edited(notes, edits).first()
    assert (row["new_content"], row["error"]) == (content, error)
