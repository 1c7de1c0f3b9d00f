"""Every query with SQL gives DuckDB's rows; the others give rows with a stable schema."""

from __future__ import annotations

import pytest

from rillmark.plans import registry
from tests.compare import differences

FOLDER = "/root/testdata/sf0.001"
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert differences(Q[name](spark, FOLDER), SQL[name], FOLDER) == []


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_gives_rows(spark, name):
    df = Q[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_flagship(spark):
    got = {r["model"] for r in registry.flagship(spark, FOLDER).collect()}
    assert {"random", "global_pop", "positive_pop", "category_pop", "content_knn", "pooled_cosine"} <= got
