"""Storage-inventory and archive-planning operators over Spark DataFrames."""

__version__ = "0.1.0"
