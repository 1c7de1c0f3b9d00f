"""How queries are registered, and the SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for publication: sums over shuffled rows differ in their last bits."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


IX = """ix AS (SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, MAX(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS label,
  MAX(o.o_orderdate) AS last_ts, CASE WHEN MAX(o.o_orderdate) < TIMESTAMP '2000-07-01 00:00:00' THEN 'train' ELSE 'test' END AS split
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2)"""
META = "meta AS (SELECT p_partkey AS item_id, p_brand AS category, p_type AS city, p_size AS province FROM part)"
VEC = "vec AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS vec FROM embeddings)"
UNIT = VEC + """, unit AS (SELECT item_id, CASE WHEN sqrt(list_sum(list_transform(vec, lambda x: x * x))) > 0
  THEN list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) ELSE vec END AS vec FROM vec)"""
PURCHASES = """buy AS (SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, l_orderkey AS order_id, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
#: Train purchases numbered from the newest, ties by every column.
RANKED = PURCHASES + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, order_id DESC, line DESC, item_id DESC) AS r
  FROM buy WHERE ts < TIMESTAMP '2000-07-01 00:00:00')"""
CLICKS = "clicks AS (SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k')::BIGINT AS item_id FROM events)"
COUNTS = IX + ", c AS (SELECT item_id, count(*) AS n FROM ix GROUP BY 1)"
