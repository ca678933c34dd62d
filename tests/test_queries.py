"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from bytelore.plans import queries, rankings, records, structures  # noqa: F401  fill the registry
from bytelore.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(f"{x[i]:.9g}" if isinstance(x[i], float) else str(x[i]) for i in order) for x in data])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for t in TABLES:
            db.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        want = db.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns) and rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
