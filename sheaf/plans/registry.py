"""All queries of the core and their SQL."""

from __future__ import annotations

from sheaf.plans import bulletins, models, point_in_time, prices, reports, weather

_MODULES = [prices, point_in_time, reports, weather, bulletins, models]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
FLAGSHIP = "backtest_summary"
