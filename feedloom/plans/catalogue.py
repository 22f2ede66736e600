"""All queries of the core and their SQL."""

from __future__ import annotations

from feedloom.plans import forum, problems

QUERIES = {**forum.QUERIES, **problems.QUERIES}
ORACLE = {**forum.ORACLE, **problems.ORACLE}
