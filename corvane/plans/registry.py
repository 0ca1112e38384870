"""Queries of the library's own operators, by name, with SQL where SQL can express them."""

from __future__ import annotations

from corvane.plans import q_models, q_pages, q_text

MODULES = (q_text, q_models, q_pages)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
