"""Ledger-archive analytics as Spark DataFrame jobs."""
