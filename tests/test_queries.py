"""Every registered query against its SQL in DuckDB, on whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents labels conversations benchmark pages events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def by_name(names: list[str], rows: list[tuple]) -> list[str]:
    places = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([row[i] for i in places]) for row in rows)


def test_every_query_has_sql():
    assert entry.library_queries().keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", entry.library_queries())
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert by_name(got.columns, got.collect()) == by_name(columns, want.fetchall())


def test_entry(spark):
    report = entry.entry(spark)
    assert report.columns[:2] == ["section", "key"]
    assert report.first()["section"] == "overall"
