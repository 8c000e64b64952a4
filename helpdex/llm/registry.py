"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from helpdex.llm import language_spans, leak_index, normal_forms, personal_data, severity, similar_vectors, splitting, tokenizing

_MODULES = (language_spans, leak_index, normal_forms, personal_data, severity, similar_vectors, splitting, tokenizing)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
