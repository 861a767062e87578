"""Inputs and outputs: registered tables, generators, configuration, rendered results."""
