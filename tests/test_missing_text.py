"""Queries against their SQL on documents that have no text."""

import duckdb
import pytest
from test_oracles import _rows

from evidenza.operators import filters
from evidenza.plans.oracles import ORACLES
from evidenza.plans.queries import QUERIES


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    text = "CASE doc_id % 9 WHEN 5 THEN NULL WHEN 6 THEN '' WHEN 7 THEN ' ' || chr(10) ELSE text END"
    duckdb.execute(f"COPY (SELECT * REPLACE ({text} AS text) FROM read_parquet('/root/testdata/sf0.001/documents.parquet')) TO '{folder}/documents.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["validate_claims", "parse_document_requests"])
def test_without_text(name, spark, odd):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet')")
    assert _rows(QUERIES[name](spark, odd).toPandas()) == _rows(duck.execute(ORACLES[name]).fetchdf())


def test_operator_refuses_blank_claims(spark):
    rows = spark.createDataFrame([("a", "t", x, 0.5, ["e"], [], None, None) for x in (None, "", " \n", "x")], "claim_id string, tenant_id string, canonical_text string, confidence double, entities array<string>, embedding_ids array<string>, valid_from long, valid_to long")
    assert [r[0] for r in rows.select(filters.claim_error()).collect()] == ["canonical_text"] * 3 + [None]
