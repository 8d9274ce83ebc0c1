"""Imports every query module, which fills the registry."""

from seriesloom.plans import history_queries, io_queries, model_queries, prepare_queries, quality_queries  # noqa: F401
from seriesloom.plans.registry import ORACLES, QUERIES  # noqa: F401
