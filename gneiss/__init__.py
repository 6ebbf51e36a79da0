"""gneiss: layered knowledge-graph analytics on Spark DataFrames."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
__version__ = "0.1.0"
