"""Named queries over the driver's tables, with their SQL."""

from __future__ import annotations

from quern.queries import chunks, extras, graph, lines, relational, search, streams

MODULES = (search, chunks, graph, lines, streams, relational, extras)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
