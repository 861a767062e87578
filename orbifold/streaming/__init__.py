"""The run log as a stream."""
