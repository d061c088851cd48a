"""lumenframe: table and stream operators for PySpark (DataFrame in, DataFrame out)."""

__version__ = "0.1.0"
