"""Column functions on vectors and constant-curvature geometry."""
