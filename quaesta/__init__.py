"""Evidence retrieval and evaluation over document collections, on Spark."""

__version__ = "0.1.0"
