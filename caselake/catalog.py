"""All registered queries of the library, with their SQL for comparison."""

from __future__ import annotations

from caselake.plans import analytics, graph, intake, relational, retrieval, structure, text, windows  # noqa: F401
from caselake.plans.registry import QUERIES, SQL  # noqa: F401
