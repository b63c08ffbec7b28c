"""Registered queries over the driver's tables."""

from attesta.plans import q_compare, q_indicators, q_ranking, q_ratings, q_sources, q_text  # noqa: F401
from attesta.plans.registry import QUERIES, SQL  # noqa: F401
