"""Whole runs: configuration, fits, the run service, and the query catalogue."""
