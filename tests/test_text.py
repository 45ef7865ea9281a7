"""Expressions over note text, on hand-made notes."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import search as Q


def value(spark, content, expression):
    return spark.createDataFrame([(content,)], "c string").select(expression(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("content", "links"),
    [
        ("[[A]] [[B|b]] ![[C#h]] [[E|]]", ["A", "B", "C#h"]),
        ("[[a\nb]] [[x]] [[x]]", ["a\nb", "x", "x"]),
        ("", []),
    ],
)
def test_links(spark, content, links):
    assert value(spark, content, X.outgoing_links) == links


def test_inline_tags(spark):
    assert value(spark, "#a é #tag-é x #b/c ##no #1x #a", X.inline_tags) == ["a", "b/c", "tag-é"]


@pytest.mark.parametrize(
    ("content", "fields"),
    [
        ("---\nt: a---b\n---", {"t": "a"}),
        ("---\na: 1\nb: x: y\na: 2\n---\nbody: no", {"a": "2", "b": "x: y"}),
        ("---\nopen", {}),
        ("x\n---\na: 1\n---", {}),
        ("---\n  k  :  v  \nno colon\n---", {"k": "v"}),
        ("", {}),
    ],
)
def test_frontmatter(spark, content, fields):
    assert value(spark, content, X.frontmatter) == fields


@pytest.mark.parametrize("text", ["a\nb\r\nc\rd", "", "\n", "a\n", "a\n\nb", "x\x0by\x0cz\x1c1\x852 3", "no end"])
def test_lines_are_those_of_splitlines(spark, text):
    assert value(spark, text, X.lines) == text.splitlines()


@pytest.mark.parametrize(("path", "stem"), [("a/v1.2 notes", "v1"), ("b.md", "b"), (".md", ".md"), ("x/y.tar.gz", "y.tar"), ("n", "n")])
def test_stem(spark, path, stem):
    assert value(spark, path, X.stem) == stem


@pytest.mark.parametrize(
    ("reply", "text"),
    [("```json\n{}\n```", "{}"), ("  {} ", "{}"), ("```\na\n  ``` \nb", "a\nb"), ("no ```", "no ```")],
)
def test_fence(spark, reply, text):
    assert value(spark, reply, X.without_fence) == text


def test_frontmatter_is_cut_out_once(spark):
    """The text is split into lines in one place of the plan, not once for each use of a line."""
    rows = spark.createDataFrame([("---\na: 1\nb: x: y\na: 2\n---\n",), ("",), (None,)], "content string").select(X.frontmatter(F.col("content")).alias("f"))
    assert [r["f"] for r in rows.collect()] == [{"a": "2", "b": "x: y"}, {}, {}]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_a_search_cuts_only_the_notes_it_shows(spark):
    rows = spark.createDataFrame([("a/b.md", "The x\n y the \nno"), ("a-b.md", "the"), ("c.md", "the"), ("d.md", None)], "path string, content string")
    found = Q.search(rows, "the", 2)
    assert sorted(map(tuple, found.collect())) == [("a-b.md", 1, "the", True), ("a/b.md", 1, "The x", False), ("a/b.md", 2, "y the", False)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
