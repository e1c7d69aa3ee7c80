"""Every registered query against its SQL, and those without SQL for rows."""

import math
import os

import duckdb
import pytest

from lodestone import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


def held_against_sql(spark, d, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = query(spark, d)
    names = sorted(df.columns)
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == names
    want = [tuple(rounded(row[columns.index(n)]) for n in names) for row in got.fetchall()]
    have = [tuple(rounded(v) for v in row) for row in df.select(*names).collect()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(have, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    held_against_sql(spark, sf, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_has_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0 or name == "evidence_fuzzy_match"  # held against brute force in test_whole.py


def test_entry_runs(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
