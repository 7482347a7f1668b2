"""Versioned, auditable retrieval and agent memory as PySpark DataFrame operators."""
