"""Queries by name, each with the SQL that must agree with it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The views of ``plumeria.sources.tables`` in SQL.
LOG = """
    log AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item,
                   epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s FROM events),
    clicks AS (SELECT * FROM log WHERE event_type = 'click'),
    views AS (SELECT * FROM log WHERE event_type = 'view'),
    requests AS (SELECT event_id AS req, user_id, s + 1 AS t FROM log WHERE event_type = 'purchase'),
    items AS (SELECT vec_id AS item, embedding AS emb, label + 1 AS category, 1704067200 + vec_id * 25200 AS pub_s
              FROM embeddings)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
