"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from terravane.plans import evaluation, exploration, geometry, localization, retrieval

FLAGSHIP = "flagship_search"
QUERIES = {}
ORACLE_SQL = {}
for _module in (retrieval, geometry, evaluation, exploration, localization):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
