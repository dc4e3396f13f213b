"""Every registered query against its SQL, in another engine, on the same files."""

import duckdb
import pytest

from telewin.plans.catalog import QUERIES
from telewin.plans.oracle import ORACLE

SF_DIR = "/root/testdata/sf0.01"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    with duckdb.connect() as db:
        db.execute(f"create view events as select * from '{SF_DIR}/events.parquet'")
        want = db.execute(ORACLE[name])
        columns = [c[0] for c in want.description]
        types = {c[0]: str(c[1]).lower() for c in want.description}
        expected = rows_of(columns, want.fetchall())
    assert expected[1], "the comparison must not be vacuous"
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == expected
    spelled = {"string": "varchar", "int": "integer"}
    assert {n: spelled.get(t, t) for n, t in got.dtypes} == types
