"""Every query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

import kmerlake.plans.comparing
import kmerlake.plans.counting
import kmerlake.plans.explaining
import kmerlake.plans.inference
import kmerlake.plans.storing
import kmerlake.plans.modelling
import kmerlake.plans.selecting  # noqa: F401
from kmerlake.plans.base import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) or name == "diagnostic_kmers"
    if name not in ORACLE_SQL:
        return
    want = con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)
        else:
            assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
