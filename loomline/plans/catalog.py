"""Importing this module registers every named query."""

from loomline.plans import catalog_align, catalog_clean, catalog_lab, catalog_ladder, catalog_model, catalog_report, catalog_truth, catalog_views  # noqa: F401
from loomline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
