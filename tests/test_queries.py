"""Every query with a DuckDB twin gives the twin's rows."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark import catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = Path(SF, f"{t}.parquet")
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def rows(df):
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, str) or type(x).__name__ in ("bool", "bool_", "Timestamp"):
            return str(x)
        return round(float(x), 8)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_rows_only(spark):
    g = catalogue.QUERIES["generated_keys"](spark, SF).toPandas()
    assert set(g.kind) == {"uniform", "zipf", "sequential", "hotspot"}
    assert (g[g.kind == "zipf"].key == "test-key-0").mean() > 0.1
    assert g[g.kind == "sequential"].key.is_unique
