"""Queries that SQL can express give the rows that DuckDB gives, on two sizes of the test tables."""

import duckdb
import pytest

from tissuelake.llm.queries import ORACLES, QUERIES


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if x is None or x != x else float(x) if not isinstance(x, str) else x for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, name, size):
    con, data = duckdb.connect(), f"/root/testdata/{size}"
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.replace({float("nan"): None})) == rows(want.astype(object).where(want.notna(), None))
