"""Where the catalogue modules register their queries and the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where one exists."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


#: SQL for the root over bucket hashes of ``h`` (key, h).
ROOT_SQL = """
b AS (SELECT {key}, substr(h, 1, 2) AS bucket, count(*) AS n,
        CAST(sum(('0x' || substr(h, 1, 15))::UBIGINT) AS VARCHAR) AS a, CAST(sum(('0x' || substr(h, 16, 15))::UBIGINT) AS VARCHAR) AS b,
        CAST(sum(('0x' || substr(h, 31, 15))::UBIGINT) AS VARCHAR) AS c, CAST(sum(('0x' || substr(h, 46, 15))::UBIGINT) AS VARCHAR) AS d
      FROM h GROUP BY {key}, substr(h, 1, 2))
SELECT {key}, CAST(sum(n) AS BIGINT) AS n_rows,
       sha256(string_agg(bucket || ':' || sha256(concat_ws('|', n, a, b, c, d)), '|' ORDER BY bucket)) AS fingerprint FROM b GROUP BY {key}"""
