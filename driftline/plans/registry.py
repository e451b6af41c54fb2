"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# Fragment shared by the SQL side: events as a two-channel signal.
SIG = ("sig AS (SELECT event_id, ts, user_id, event_type, value, "
       "CAST(json_extract(props, '$.k') AS DOUBLE) AS k, epoch_us(ts) AS us FROM events)")


def query(name: str, sql: str | None = None):
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add
