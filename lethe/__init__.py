"""lethe: evaluation, statistics and corpus operators for PySpark DataFrames."""

__version__ = "0.1.0"
