"""Every query of the library against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from evidenza.plans.oracles import ORACLES
from evidenza.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return c


def _text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("null" if v is None or pd.api.types.is_scalar(v) and pd.isna(v) else _text(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data):
    found = QUERIES[name](spark, data).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    wanted = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert _rows(found) == _rows(wanted)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
