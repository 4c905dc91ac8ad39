"""Named queries over the driver tables, each with the SQL that a second engine runs."""

from . import alerting, caching, details, more, operations, quality, reports, retrieval, variants
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "alerting", "caching", "details", "more", "operations", "quality", "reports", "retrieval", "variants"]
