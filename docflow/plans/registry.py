"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import feature_queries, pdf_queries, table_queries, text_queries

QUERIES = {**text_queries.QUERIES, **table_queries.QUERIES, **pdf_queries.QUERIES, **feature_queries.QUERIES}
SQL = {**text_queries.SQL, **table_queries.SQL, **pdf_queries.SQL, **feature_queries.SQL}
