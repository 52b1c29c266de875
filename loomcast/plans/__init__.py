"""Registered queries, grouped by topic; importing a topic registers its queries."""

from loomcast.plans import reshape, validation  # noqa: F401  isort: skip
from loomcast.plans import series_features, series_models, ensembles, lag_models  # noqa: F401  isort: skip
from loomcast.plans.registry import ORACLE, QUERIES
from loomcast.plans.validation import flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
