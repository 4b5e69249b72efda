"""Readers of captured text and JSON, and the report writers."""
