"""Long-read transcript catalogues as lazily composed Spark DataFrames."""

__version__ = "0.1.0"
