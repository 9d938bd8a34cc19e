"""All SQL statements by query name."""

from __future__ import annotations

from manualdex.oracle import catalog, jobs, questions, scalars, search

PARTS = [search.SEARCH, search.TEXT, *catalog.PARTS, *questions.PARTS, *scalars.PARTS, *jobs.PARTS]
