"""Security analytics over source trees, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
