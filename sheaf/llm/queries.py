"""All queries of the package and their SQL."""

from __future__ import annotations

from sheaf.llm import q_bulletins, q_documents, q_headlines

_MODULES = [q_headlines, q_bulletins, q_documents]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
