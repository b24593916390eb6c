"""Every query that has SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

import wicker.plans.queries as tabular
import wicker.plans.deeper  # noqa: F401
import wicker.plans.further  # noqa: F401
import wicker.plans.wider  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(tabular.ORACLE))
def test_same_rows(spark, db, name):
    df = tabular.QUERIES[name](spark, FOLDER)
    rel = db.sql(tabular.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain(df.collect(), df.columns) == plain(rel.fetchall(), rel.columns)
