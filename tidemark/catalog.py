"""Every registered query of the analytics engine, by name, with its oracle."""

from __future__ import annotations

from tidemark.plans import extraction, market, profiles, records, serving

FLAGSHIP = "skill_demand"
MODULES = (market, serving, records, extraction, profiles)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
