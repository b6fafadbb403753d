"""Every registered query of the state engine against its SQL."""

import duckdb
import pandas as pd
import pytest

from lodestate import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def text_of(value):
    """Text by which a value is compared: null in any of its forms is empty, a whole number has no decimal point."""
    if not hasattr(value, "__len__") and pd.isna(value):
        return ""
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def rows(frame):
    return sorted("|".join(map(text_of, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF).toPandas()
    want = duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want[list(got.columns)])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
