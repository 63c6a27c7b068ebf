"""Every registered query of the library with the SQL that must agree with it."""

from __future__ import annotations

from fernloom.operators import aggregates, alerts, aliases, changes, domain, filtering, identity, ingest, joins, lifecycle, plugins, ranking, secondary, setops, setsim, text, topk, wordsearch  # noqa: F401
from fernloom.plans import search
from fernloom.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "search_first_page"
QUERIES |= search.QUERIES
ORACLE_SQL |= search.ORACLE_SQL
