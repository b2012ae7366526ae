"""Every registered query against its SQL."""

import duckdb
import pandas as pd
import pytest
from murmura import plans

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("set timezone = 'UTC'")
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def plain(frame):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(row[c]) for c in sorted(frame.columns)) for _, row in frame.iterrows())


def test_every_query_is_covered():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"slot_assignment", "embedding_build"}  # tested in test_knowledge.py and test_providers.py


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = plans.queries()[name](spark, DATA).toPandas()
    want = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert plain(found) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
