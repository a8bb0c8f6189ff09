"""All registered queries of the package proper, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tarnfold.plans import state_queries, stream_queries, text_queries

QUERIES = state_queries.QUERIES | text_queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL = state_queries.ORACLE_SQL | text_queries.ORACLE_SQL | stream_queries.ORACLE_SQL
