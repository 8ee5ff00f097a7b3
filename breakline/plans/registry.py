"""All registered queries of the engine and the SQL that they equal."""

from __future__ import annotations

from . import catalog, found, long, recursions, sums

QUERIES: dict = {**catalog.QUERIES, **recursions.QUERIES, **long.QUERIES, **sums.QUERIES, **found.QUERIES}
SQL: dict = {**catalog.SQL, **recursions.SQL, **long.SQL, **sums.SQL, **found.SQL}
