"""Plans over a text column."""

from rampart.plans.pipeline import audit, detections, sanitize, source_rollup

__all__ = ["audit", "detections", "sanitize", "source_rollup"]
