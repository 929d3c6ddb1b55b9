"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from papyra.plans import literature, records, writes

FLAGSHIP = "co_mentioned_genes"
QUERIES = {**records.QUERIES, **literature.QUERIES, **writes.QUERIES}
ORACLE = {**records.ORACLE, **literature.ORACLE, **writes.ORACLE}
