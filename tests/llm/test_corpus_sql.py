"""Corpus queries against their SQL, in another engine, on the same files."""

import duckdb
import pytest

from telewin.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    with duckdb.connect() as db:
        for table in ("documents", "embeddings"):
            db.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
        want = db.execute(ORACLE[name])
        types = {c[0]: str(c[1]).lower() for c in want.description}
        expected = want.fetchall()
    assert expected
    order = list(types)
    assert sorted([tuple(r) for r in got.select(*order).collect()], key=str) == sorted(expected, key=str)
    spelled = {"string": "varchar", "int": "integer"}
    assert {n: spelled.get(t, t) for n, t in got.dtypes} == types
