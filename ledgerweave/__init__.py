"""Federated analytics over multi-tenant ledgers, written as PySpark jobs."""

__version__ = "0.1.0"
