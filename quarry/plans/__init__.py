"""Registered queries."""

from quarry.plans import callgraphs, estate, extracts, models, relations, scans, scripts, settings, trees, workitems  # noqa: F401
from quarry.plans.registry import QUERIES, SQL  # noqa: F401
