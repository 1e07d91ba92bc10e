"""All queries over the test tables, and their SQL."""

from __future__ import annotations

from rubrica.operators import queries_fields, queries_metrics, queries_more, queries_rows, queries_tasks, queries_text  # noqa: F401
from rubrica.operators.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
