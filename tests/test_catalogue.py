"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from pageloom.plans import catalogue, layouts, pages, rasters, reading, segments, texts  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    norm = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "ifb" else str(x)
    return sorted((tuple(norm(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
