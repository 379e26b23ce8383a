"""All queries outside the training-data subpackage."""

from __future__ import annotations

from tideline.plans import catalog, q_aggregates, q_expressions, q_joins, q_lists, q_models, q_quality, q_sources, q_windows  # noqa: F401  (they register their queries)

queries = catalog.queries
oracle_sql = catalog.oracle_sql
