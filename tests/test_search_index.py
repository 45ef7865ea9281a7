import pytest
from pyspark.sql import functions as F

from marginalia.operators import search as Q
from marginalia.operators import search_index as X

TEXTS = [
    "The quick brown fox\njumps over it",
    "a MIT License\r\nand more\nlicense again",
    "nothing",
    "",
    None,
    "\u017fummary of \u212aelvin, \u0130stanbul and \u0131stanbul",
    "price (in $) + tax",
    "äöü only here",
    "license " * 3000,
    "abc-abc-abcabc",
]


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(f"dir/n{k:03d}.md", text) for k, text in enumerate(TEXTS)]
    rows += [(f"many/m{k:03d}.md", f"filler number {k}\nthe common words") for k in range(120)]
    rows += [(".hidden/x.md", "license"), ("dir/n001.md", "license twice"), (None, "license of no path")]
    return spark.createDataFrame(rows, "path string, content string").repartition(5)


@pytest.fixture(scope="module")
def index(notes):
    return X.SearchIndex.build(notes)


QUERIES = [
    "license", "LICENSE", "mit licen[sc]e", "(abc)+", "a(bc-)+abc", "summary", "kelvin", "istanbul", "common words", "filler number 1",
    "fox|nothing", "^the", "x*", "(in $", "no such text", "äöü", "qu.ck", "it", "over it$", r"\bjumps\b", "((", "number (?=7)",
]


@pytest.mark.parametrize("query", QUERIES)
def test_index_gives_what_a_scan_gives(notes, index, query):
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(map(tuple, index.search_lines(query).collect()), key=key)
    assert got == sorted(map(tuple, Q.search_lines(notes, query).collect()), key=key)


def test_cutoff_through_the_index(notes, index):
    for query in ("license", "filler", "number 7"):
        assert sorted(map(tuple, index.search(query).collect())) == sorted(map(tuple, Q.search(notes, query).collect()))


def test_required_texts():
    assert X.required_texts("mit licen[sc]e") == ["mit licen", "e"]
    assert X.required_texts(r"\bab(cd)e+f?") == ["abcd", "e"]
    assert X.required_texts("a|b") == []
    assert X.required_texts("x(?:yz)*(?!no)w") == ["x", "w"]


def test_rare_words_read_few_files(index):
    """A search reads the folders of its candidates alone; one for a gram that no note has reads none."""
    files = lambda df: df.select(F.col("_metadata.file_path")).distinct().count()
    everything = files(index.notes())
    found = index.candidates("brown fox")
    assert everything > 20 and found.count() == 1
    read = index.notes().where(F.col("part").isin([r["part"] for r in found.collect()]))
    assert files(read) <= 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan
    assert index.rarest("zzqqxx") is None and index.rarest("a|b") == []


def test_an_empty_table(spark):
    empty = X.SearchIndex.build(spark.createDataFrame([], "path string, content string"))
    assert empty.search_lines("license").count() == 0 and empty.search("x*").count() == 0


def test_postings_are_blocks_of_notes(spark, index):
    """A gram of 120 notes is some rows of many notes, and the grams of a text are those of its lines."""
    postings = index.table("postings", "gram string, notes array<long>, part int").where("gram = 'fil'")
    assert postings.count() <= 5 and postings.agg(F.sum(F.size("notes"))).first()[0] == 120
    grams, rows = X.note_grams(["ab\ncd\u017fE", "", "xyzxyz"])
    names = [bytes((g >> 16, g >> 8 & 255, g & 255)).decode() for g in grams.tolist()]
    assert sorted(zip(rows.tolist(), names)) == [(0, "cds"), (0, "dse"), (2, "xyz"), (2, "yzx"), (2, "zxy")]
