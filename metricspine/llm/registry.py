"""All registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import queries_documents, queries_quality, queries_similarity

_MODULES = (queries_documents, queries_quality, queries_similarity)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
