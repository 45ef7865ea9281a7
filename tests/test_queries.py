"""Every query of the catalog against its SQL, over small tables."""

import os

import duckdb
import pytest

from marginalia import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, tables, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), tables.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_roundtrip_takes_every_note(spark):
    whole = {row["path"] for row in catalog.docs(spark, SF).collect()}
    assert {row["path"] for row in catalog.QUERIES["vault_source_roundtrip"](spark, SF).collect()} == whole
    # a smaller table does not find the notes of the one before
    few = catalog.vault_roundtrip(spark, catalog.docs(spark, SF).limit(3))
    assert few.count() == 3


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["note_a", "note_b", "n_shared", "shared"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
