"""Operators put together: the alignment pipeline, experiments, and the named queries."""
