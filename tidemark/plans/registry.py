"""Registry of queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The change log in DuckDB.
LOG = """
WITH l AS (
  SELECT user_id AS key, event_id AS ts, event_type = 'error' AS del, CASE WHEN event_type <> 'error' THEN value END AS value,
         event_id // 10 AS tx_id,
         CASE WHEN (event_id // 10) % 7 = 0 THEN 'rollback' WHEN (event_id // 10) % 11 = 0 THEN 'open' ELSE 'commit' END AS status
  FROM events
)"""
#: Newest version first.
RANKED = LOG + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS r FROM l)"
#: With the version before.
LINKED = LOG + """, p AS (
  SELECT *, lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev_value, lag(del) OVER w AS prev_del FROM l WINDOW w AS (PARTITION BY key ORDER BY ts)
)"""


def query(sql: str | None = None):
    """Register a query of (spark, sf_dir), and its twin if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
