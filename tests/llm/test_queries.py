from pathlib import Path

import duckdb
import pytest

from lorekiln.llm import queries

DATA = Path("/root/testdata/sf0.001")


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, str(DATA)).toPandas()
    if name in queries.ORACLES:
        c = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = c.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
