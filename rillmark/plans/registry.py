"""All queries of the library by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillmark.plans import encodings, learning, profiles, report, streams  # noqa: F401 - importing a module registers its queries
from rillmark.plans.base import QUERIES, SQL, Query


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """How well each popularity scorer ranks every user's test items."""
    return QUERIES["per_user_ranking"](spark, folder)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
