"""Media-library retrieval and metadata analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
