"""The queries that SQL expresses against their SQL."""

import duckdb
import pytest

from evidentia.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.queries()[name](spark, SF)
    want = db.execute(Q.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r[n] for n in names) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want.fetchall()))
