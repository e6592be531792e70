"""Registered queries, one module per family."""

from panelspark.plans import aggregates, joins, panels, scalars, wide  # noqa: F401
from panelspark.plans.registry import ORACLES, QUERIES  # noqa: F401
