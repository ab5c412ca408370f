"""Registry of queries over the driver tables, each with its SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The canonical event view in SQL; the DataFrame form is sources.views.events.
EVENTS_SQL = "ev AS (SELECT event_id AS id, user_id AS actor, event_type AS kind, json_extract_string(props, '$.k') AS channel, value, props AS meta, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"


def _cast(longs: tuple[str, ...], sql: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in longs)}) FROM ({sql})" if longs else sql


def query(sql: str | None = None, longs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its name. EV in sql stands for the canonical event view; longs are columns to give as BIGINT."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _cast(longs, sql.replace("EV,", EVENTS_SQL + ",").replace("EV\n", EVENTS_SQL + "\n").replace("EV ", EVENTS_SQL + " "))
        return f

    return add
