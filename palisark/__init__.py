"""Security analytics and training-data preparation as PySpark jobs."""

__version__ = "0.1.0"
