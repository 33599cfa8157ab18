"""Planned, skew-aware, padded shuffle analytics on PySpark."""
