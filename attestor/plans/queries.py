"""All queries of the library but those of the corpus subpackage, and their SQL."""

from __future__ import annotations

from . import stream_queries, table_queries, text_queries

QUERIES, ORACLE = {}, {}
for module in (text_queries, table_queries, stream_queries):
    if twice := set(QUERIES) & set(module.QUERIES):
        raise ValueError(f"queries of two modules share names: {sorted(twice)}")
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
