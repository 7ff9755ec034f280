"""All queries of the core, and their SQL."""

from __future__ import annotations

from cadenza.plans import core, hot, small_files

QUERIES = {**core.QUERIES, **hot.QUERIES, **small_files.QUERIES}
SQL = {**core.SQL, **hot.SQL, **small_files.SQL}
FLAGSHIP = "category_distribution"
