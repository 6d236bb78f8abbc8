"""Every query of the catalogue agrees with its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from cairn.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(df, columns):
    """Rows as text; whole floats as integers, since pandas gives nullable integers as floats."""

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return sorted(str([plain(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, FOLDER)
    if name not in catalogue.oracle_sql():
        got.collect()
        return
    want, got = con.sql(catalogue.oracle_sql()[name]).df(), got.toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = rows(want, columns), rows(got, columns)
    assert len(a) == len(b)
    assert a == b
