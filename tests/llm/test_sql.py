"""The queries of this subpackage that have SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from plexmill.llm import queries
from tests.conftest import SF


def rows(df):
    return sorted(repr([None if v is None or v != v else v for v in r]) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, SF)
    whole = [c for c, kind in got.dtypes if kind == "bigint"]
    got, want = got.toPandas().astype({c: "Int64" for c in whole}), con.execute(queries.ORACLE_SQL[name]).df().astype({c: "Int64" for c in whole})
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
