"""All core queries by name, with the SQL that each is checked against."""

from __future__ import annotations

from lodestone.plans import integrity, records, retrieval

_MODULES = (retrieval, records, integrity)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
flagship = retrieval.metric_summary
