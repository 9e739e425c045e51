"""Queries of the problems on training data and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib

_PARTS = ("q_mixing", "q_overlap", "q_neighbours", "q_tokens", "q_leaks", "q_residue")
_MODULES = [importlib.import_module(f"loomspar.llm.{p}") for p in _PARTS]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
