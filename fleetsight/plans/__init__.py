"""All registered queries."""

from fleetsight.plans import attributes, core, identity, masks, points, review, streams, telemetry, tracking  # noqa: F401
from fleetsight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
