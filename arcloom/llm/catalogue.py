"""All queries of the training-data operators, by name, with SQL where SQL can express them."""

from __future__ import annotations

from arcloom.llm import encoding, functions, hidden_text, languages, mixing, provenance, splitting, syntax, truncation

MODULES = [truncation, syntax, hidden_text, functions, splitting, provenance, encoding, mixing, languages]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
