"""All queries of the library's own operators, with their DuckDB oracles.

Each module of ``textloom.plans`` holds a ``QUERIES`` and an ``ORACLES`` dict under the same names.
"""

from __future__ import annotations

from textloom.plans import details, extracting, libraries, mining, reading, state, streams, syncing, tables, texts, timelines, upkeep

MODULES = (state, texts, timelines, syncing, extracting, details, libraries, streams, upkeep, reading, tables, mining)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
