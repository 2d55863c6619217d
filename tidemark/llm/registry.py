"""The corpus queries op1 to op13, by name, with the oracles that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat, codes, hardneg, licences, lm, mpeg, neardup, packing, pieces, quality, rollup, suffixes, topk

MODULES = (chat, codes, hardneg, licences, lm, mpeg, neardup, packing, pieces, quality, rollup, suffixes, topk)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
