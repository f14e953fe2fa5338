"""Every query of the reference's operators against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from chorale.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, data, name):
    ours = QUERIES[name](spark, data).toArrow()
    theirs = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    columns = ", ".join(f'"{c}"' for c in sorted(ours.column_names))
    duck.register("ours", ours)
    duck.register("theirs", theirs)
    assert ours.num_rows == theirs.num_rows
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall()[:3] == []


def test_every_query_has_sql_but_the_clustering():
    assert set(QUERIES) - set(ORACLES) == {"div_trajectory_cluster"}


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
