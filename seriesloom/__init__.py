"""seriesloom: comparable time series assembled from competing, cited readings, on PySpark."""

__version__ = "0.1.0"
