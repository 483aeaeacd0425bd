"""Orrery: a knowledge-retrieval and diagnosis engine on the PySpark DataFrame API."""

__version__ = "0.1.0"
