"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from ..functions.dialect import oracle, spark_query
from ..operators import corpus, gates, geometry
from . import frames, proxy, reports, solids, surfaces

SQL = {name: sql for name, sql in (gates.SQL | corpus.SQL | geometry.SQL).items() if name not in frames.QUERIES and name not in surfaces.QUERIES}


def queries() -> dict:
    return {name: spark_query(sql, proxy.SPREAD) for name, sql in SQL.items()} | frames.QUERIES | reports.QUERIES | solids.QUERIES | surfaces.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in (SQL | frames.PLAIN | surfaces.PLAIN | frames.ORACLES | reports.ORACLES).items()} | solids.ORACLES | surfaces.ORACLES
