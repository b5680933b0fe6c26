"""The catalogue of queries: each applies one operator to the test tables; SQL for an independent engine beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from tidewell.plans import reports as _reports  # noqa: E402

for _name in _reports.REPORTS:
    QUERIES[_name] = lambda spark, sf_dir, n=_name: _reports.report(n, spark, sf_dir)
    ORACLE_SQL[_name] = _reports.oracle(_name)

from tidewell.queries import scoring, memory, rounds, kept, retrieval, writing, measures, streams, capture, gates, files  # noqa: E402, F401
