"""Document retrieval, memory, cache, fusion and telemetry as Spark DataFrame jobs."""

__version__ = "0.1.0"
