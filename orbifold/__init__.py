"""Constant-curvature embedding analytics on Spark."""
