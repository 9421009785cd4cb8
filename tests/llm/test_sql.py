"""Every query of the operators that has SQL gives DuckDB's rows."""

from collections import Counter

import duckdb
import pytest

from stratafind.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    rows = Counter(tuple(r[c] for c in names) for r in got.collect())
    want = con.execute(oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == names
    assert rows == Counter(tuple(r[order.index(c)] for c in names) for r in want.fetchall())
