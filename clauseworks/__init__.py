"""clauseworks: retrieval and data-processing analytics for structured provisions, on Spark DataFrames."""

__version__ = "0.1.0"
