"""Queries of the signal engine: name -> callable, and the SQL that checks them."""

from __future__ import annotations

from .plans import model_queries, register, signal_queries, store_queries, table_queries

FLAGSHIP = "window_features"
QUERIES, ORACLE_SQL = register.QUERIES, register.SQL

__all__ = ["FLAGSHIP", "QUERIES", "ORACLE_SQL", "model_queries", "signal_queries", "store_queries", "table_queries"]
