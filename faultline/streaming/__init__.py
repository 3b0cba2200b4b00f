"""Incremental forms of the history features."""
