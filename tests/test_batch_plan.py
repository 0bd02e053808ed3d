"""A batch of queries deals nothing large by tenant, token or query, whatever Spark itself would broadcast."""

import pytest

from evidenza.plans import retrieve as plans
from evidenza.sources.fixtures import load


@pytest.fixture
def joined(spark, data, monkeypatch):
    """The keys of the sort-merge joins in the plans of a batch, those of the postings too."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    frames, write = [], plans.written
    monkeypatch.setattr(plans, "written", lambda df, name: frames.append(df) or write(df, name))
    asked = spark.createDataFrame([(0, "en", "the of", ["src1"]), (1, "de", "zzzzqq", None)], "query_id long, tenant_id string, query string, entities array<string>")
    frames.append(plans.retrieve_batch(load(spark, data), asked, 5))
    yield [line.split("SortMergeJoin ", 1)[1] for df in frames for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin " in line]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_texts_and_postings_are_not_dealt_by_tenant_or_token(joined):
    assert not [x for x in joined if x.startswith(("[tenant_id", "[token"))]


def test_candidates_are_not_dealt_by_query(joined):
    assert joined and not [x for x in joined if x.startswith("[query_id")]


def test_a_batch_too_large_to_send(spark, data, monkeypatch):
    asked = spark.createDataFrame([(0, "en", "the of and the"), (1, "de", "zzzzqq")], "query_id long, tenant_id string, query string")
    rows = lambda: sorted(tuple(r) for r in plans.retrieve_batch(load(spark, data), asked, 5).select("query_id", "rank", "claim_id").collect())
    wanted = rows()
    monkeypatch.setattr(plans, "MOST_SENT", 1)
    assert rows() == wanted and len(wanted) == 10
