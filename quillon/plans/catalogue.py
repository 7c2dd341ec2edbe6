"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from . import graph_queries, io_queries, network_queries, response_queries

QUERIES: dict = response_queries.QUERIES | network_queries.QUERIES | io_queries.QUERIES | graph_queries.QUERIES
ORACLES: dict = response_queries.ORACLES | network_queries.ORACLES | io_queries.ORACLES | graph_queries.ORACLES
