"""All queries of the general part, with their DuckDB equivalents."""

from __future__ import annotations

from larder.plans import dataset, dedup, selection, texts

QUERIES = {**dedup.QUERIES, **dataset.QUERIES, **texts.QUERIES, **selection.QUERIES}
ORACLE = {**dedup.ORACLE, **dataset.ORACLE, **texts.ORACLE, **selection.ORACLE}
