"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from lodestone.llm import defects, encoding, formatting, neardup, overlap, packing, sentences

_MODULES = (overlap, neardup, formatting, encoding, packing, defects, sentences)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
