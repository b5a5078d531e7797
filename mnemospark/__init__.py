"""A document-memory engine on Spark: ingestion, hybrid retrieval, maintenance and text-corpus operators."""

__version__ = "0.1.0"
