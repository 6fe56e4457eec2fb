"""All queries by name, with the DuckDB SQL that checks each."""

from __future__ import annotations

from textloom.plans import alignment_queries, article_queries, paragraph_queries, retrieval_queries, serving_queries, streaming_queries, text_queries  # noqa: F401  registers
from textloom.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
