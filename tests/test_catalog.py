import pytest

from folioforge.plans import annotation_queries, calibration_queries, catalog, context_queries, engine_queries, evidence_queries, layout_queries, ranking_queries  # noqa: F401 (these register their queries)
from tests.parity import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    same(catalog.QUERIES[name](spark, sf), duck.sql(catalog.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs_alike_twice(spark, sf, name):
    a, b = (sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect()), key=repr) for _ in range(2))
    assert a == b and a


def test_evidence_queries_are_registered():
    assert catalog.QUERIES["evidence_view"] is evidence_queries.evidence_view


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
