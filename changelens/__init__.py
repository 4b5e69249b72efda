"""Change analytics on Spark: what changed between two revisions, and how much of it matters."""

__version__ = "0.1.0"
