"""Review-authenticity analytics expressed as Spark DataFrame, MLlib and Structured Streaming jobs."""

__version__ = "0.1.0"
