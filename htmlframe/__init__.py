"""htmlframe: HTML documents as distributed, queryable Spark tables."""

__version__ = "0.1.0"
