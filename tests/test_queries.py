"""Every registered query of the library against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from anchorline.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return str(v)[:10] if hasattr(v, "year") else v if isinstance(v, bool) else float(v) if isinstance(v, int) else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(([cell(v) for v in r] for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    (mine, a), (theirs, b) = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(duck.sql(SQL[name]).df())
    assert mine == theirs
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-4) if all(isinstance(v, float) for v in x + y) else all(v == w or (isinstance(v, float) and isinstance(w, float) and abs(v - w) <= 2e-4) for v, w in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
