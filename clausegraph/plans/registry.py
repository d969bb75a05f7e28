"""Registered queries of the reference's operators and the DuckDB SQL they are held against."""

from __future__ import annotations

from clausegraph.plans import graph_queries, operator_queries, retrieval_queries

QUERIES = retrieval_queries.QUERIES | graph_queries.QUERIES | operator_queries.QUERIES
SQL = retrieval_queries.SQL | graph_queries.SQL | operator_queries.SQL
