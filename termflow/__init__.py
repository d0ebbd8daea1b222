"""termflow -- annotation analytics over term DAGs on Spark DataFrames."""

__version__ = "0.1.0"
