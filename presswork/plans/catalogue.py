"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import build_queries, document_queries, event_queries, item_queries, state_queries, time_queries

QUERIES = {**event_queries.QUERIES, **document_queries.QUERIES, **state_queries.QUERIES, **item_queries.QUERIES, **build_queries.QUERIES, **time_queries.QUERIES}
SQL = {**event_queries.SQL, **document_queries.SQL, **state_queries.SQL, **item_queries.SQL, **build_queries.SQL, **time_queries.SQL}
