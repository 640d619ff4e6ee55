"""All registered queries."""

from veilwork.plans import catalog_detect, catalog_mask, catalog_review  # noqa: F401
from veilwork.plans.catalog_mask import flagship
from veilwork.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]
