"""Marketplace analytics as PySpark DataFrame jobs."""
