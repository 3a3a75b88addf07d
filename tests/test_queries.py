"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from rewindle.plans.oracle import ORACLE  # noqa: E402
from rewindle.plans.registry import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS FROM '{file}'")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    duck.register("got", got)
    duck.register("want", want)
    for a, b in (("got", "want"), ("want", "got")):
        rest = f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}"
        assert duck.sql(f"SELECT count(*) FROM ({rest})").fetchall() == [(0,)]
    assert got.num_rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
