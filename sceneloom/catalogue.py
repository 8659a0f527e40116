"""All registered queries of the scene-graph operators and their SQL."""

from __future__ import annotations

from .plans import queries_aggregates, queries_artifacts, queries_files, queries_filters, queries_joins, queries_state, queries_streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
