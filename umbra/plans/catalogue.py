"""Registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from umbra.plans import detection, governance, identifiers, requests, texts

_MODULES = [detection, governance, identifiers, requests, texts]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
