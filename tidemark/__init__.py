"""tidemark — revenue analytics over payment-provider events, written as Spark jobs."""

__version__ = "0.1.0"
